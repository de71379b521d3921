"""Character sets of fetched bodies."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

_DECLARED = r"""(?i)(?:encoding|charset)\s*=\s*["']?([a-z0-9][a-z0-9._:-]*)"""
_UTF8 = ("", "utf-8", "utf8", "us-ascii", "ascii")
# Fixed values of the web's encoding standard: what pages under these labels are really written in.
_AS_USED = {
    "gb2312": "gb18030", "gb_2312": "gb18030", "gb_2312-80": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030",
    "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "iso_8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252",
    "iso-8859-9": "cp1254", "latin5": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932",
    "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "big5": "big5hkscs", "x-x-big5": "big5hkscs",
}
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def _open_bytes(problem: UnicodeError) -> tuple[str, int]:
    if not isinstance(problem, UnicodeDecodeError):
        raise problem
    return problem.object[problem.start : problem.end].decode("latin-1"), problem.end


@F.pandas_udf(StringType())
def _decoded(raw: pd.Series, declared: pd.Series) -> pd.Series:
    codecs.register_error("gleaner-open-bytes", _open_bytes)

    def one(data: bytes | None, name: str | None) -> str | None:
        if data is None:
            return None
        data = bytes(data)
        marked = next((codec for mark, codec in _MARKS if data.startswith(mark)), None)
        codec = marked or _AS_USED.get(name, name) or "utf-8"
        try:
            # bytes that a Windows code page leaves open are control characters
            return data.decode(codec, "gleaner-open-bytes" if codec.startswith("cp125") else "strict")
        except (LookupError, UnicodeDecodeError):
            return None

    return pd.Series([one(data, name) for data, name in zip(raw, declared)], dtype=object)


def with_body_text(frame: DataFrame, name: str = "_text", body: str = "body") -> DataFrame:
    """Add the text of a body; null where the body is missing or can't be decoded.

    Text bodies are taken as they are.  Bytes are UTF-8 unless a byte order mark or
    a declaration near their start (``encoding=`` or ``charset=``) says otherwise; labels
    mean what pages under them are written in, as in browsers (GB 18030 for gb2312).
    Only bodies that are not plain UTF-8 go to a Python worker; the others pass it
    as nulls.
    """
    if not isinstance(frame.schema[body].dataType, BinaryType):
        return frame.withColumn(name, F.col(body).cast("string"))
    raw = F.col(body)
    start = F.decode(F.substring(raw, 1, 1024), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(start, _DECLARED, 1))
    marked = F.hex(F.substring(raw, 1, 2)).isin("FFFE", "FEFF") | (F.hex(F.substring(raw, 1, 3)) == "EFBBBF")
    plain = declared.isin(*_UTF8) & ~marked & F.is_valid_utf8(raw.cast("string"))
    other = _decoded(F.when(~plain, raw), F.when(~plain, F.nullif(declared, F.lit(""))))
    return frame.withColumn(name, F.coalesce(F.when(plain, raw.cast("string")), other))
