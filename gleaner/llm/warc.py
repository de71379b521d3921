"""WARC archives as a Python data source, for reading and writing.

``spark.read.format("warc").load(folder)`` plans one partition per group of files,
checks pushed filters on header columns while only the start of a record is
inflated, and decodes a payload only if the schema asks for it::

    spark.read.format("warc").schema("record_id string, target_uri string").load(folder)

Every record is a gzip member of its own, as the format recommends.  Members carry
their length in an extra field (``sl``), so a reader steps over a record it doesn't
want without inflating it; archives without the field are read as well.

Writing takes the columns of ``SCHEMA`` it finds.  A task writes files of about
``FILE_BYTES`` under ``_temporary``; the commit moves the files of successful tasks
to their place, so lost and repeated tasks leave nothing behind that is read.

``payload_bytes`` is the length of a record's block without the HTTP header it may
begin with, whatever columns are asked for.  A null payload is an empty one.  A revisit
has the headers of the response it stands for and no payload; its length is the one
its HTTP header tells.  Line breaks in
header values become blanks; null headers are left out.  Columns the source does
not know are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from gleaner.llm import exact_dedup
from gleaner.llm.common import with_group_facts
from gleaner.session import written

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)
# Fixed values of the format.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_EXTRA = "<2sHII"  # an extra field: name, size, length of the member, length of the record

FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
_FIRST_READ = 4096
SMALLEST_REVISIT = 100


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def member(record: bytes) -> bytes:
    """A gzip member that tells its own length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(record) + packer.flush()
    size = 10 + 2 + struct.calcsize(_EXTRA) + len(packed) + 8
    known = size < 1 << 32
    extra = struct.pack(_EXTRA, b"sl", 8, size if known else 0, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + packed + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    length = row["payload_bytes"] if kind == "revisit" and row.get("payload_bytes") is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    headers = {**{column: row.get(column) for column in HEADERS}, "record_type": kind}
    headers["warc_date"] = headers["warc_date"] or "1970-01-01T00:00:00Z"
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = headers[column]
        if value is None:
            continue
        value = re.sub(r"[\r\n\0]", " ", value)
        value = f"<{value}>" if column in ("record_id", "refers_to") else f"sha256:{value}" if column == "payload_digest" else value
        lines.append(f"{name}: {value}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def _fields(head: bytes) -> dict[str, str]:
    return {
        name.strip().lower(): value.strip()
        for name, _, value in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    }


def parse_head(head: bytes) -> tuple[dict[str, str | None], int, bool]:
    """The header columns of a record, the length of its block, and whether that begins with an HTTP header."""
    fields = _fields(head)
    found: dict[str, str | None] = {column: fields.get(name.lower()) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        if found[column]:
            found[column] = found[column].removeprefix("<").removesuffix(">")
    if found["payload_digest"]:
        found["payload_digest"] = found["payload_digest"].rpartition(":")[2]
    return found, int(fields.get("content-length") or 0), fields.get("content-type", "").startswith("application/http")


class _Member:
    """One gzip member of an open file; inflates as far as it is asked to."""

    def __init__(self, file, start: int):
        self.file, self.start, self.length = file, start, 0
        file.seek(start)
        raw = file.read(_FIRST_READ)
        self.ended = len(raw) < 18 or raw[:2] != b"\x1f\x8b"
        if self.ended:
            return
        flags, at = raw[3], 10
        if flags & 4:
            (wide,) = struct.unpack_from("<H", raw, 10)
            if wide >= struct.calcsize(_EXTRA) and raw[12:14] == b"sl":
                self.length = struct.unpack_from(_EXTRA, raw, 12)[2]
        # the whole member goes through the gzip reader, header included
        self.inflater, self.raw, self.out = zlib.decompressobj(31), raw, b""
        self.at = at

    def upto(self, mark: bytes, start: int = 0) -> int:
        """Inflate until ``mark`` is there; its place, or -1 if it never comes."""
        while (place := self.out.find(mark, start)) < 0 and self._more(_FIRST_READ):
            pass
        return place

    def whole(self) -> bytes:
        while self._more(0):
            pass
        return self.out

    def _more(self, most: int) -> bool:
        if self.inflater.eof:
            return False
        if not self.raw:
            self.raw = self.file.read(1 << 20 if not most else _FIRST_READ)
            if not self.raw:
                return False
        self.out += self.inflater.decompress(self.raw, most)
        self.raw = self.inflater.unconsumed_tail
        return True

    def next_start(self) -> int:
        if self.length:
            return self.start + self.length
        self.whole()
        # what lies behind the member's end is in unused_data alone
        return self.file.tell() - len(self.inflater.unused_data)


def _passes(filters: list[Filter], found: dict[str, str | None]) -> bool:
    for one in filters:
        value = found.get(one.attribute[0])
        if isinstance(one, EqualTo) and value != one.value:
            return False
        if isinstance(one, In) and value not in one.value:
            return False
        if isinstance(one, StringStartsWith) and not (value or "").startswith(one.value):
            return False
        if isinstance(one, IsNotNull) and value is None:
            return False
    return True


@dataclass
class _Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns, self.filters = path, schema.names, []

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            header = getattr(one, "attribute", ()) and one.attribute[0] in HEADERS
            if header and isinstance(one, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.filters.append(one)
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        system, folder = open_folder(self.path)
        files = [one for one in system.get_file_info(fs.FileSelector(folder)) if one.is_file and one.base_name.endswith(".warc.gz")]
        groups: list[list[str]] = []
        room = 0
        for one in sorted(files, key=lambda one: one.path):
            if one.size > room or not groups:
                groups.append([])
                room = FILE_BYTES
            groups[-1].append(one.path)
            room -= one.size
        return [_Files(names) for names in groups] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        wanted = {name: kinds.get(name, pa.string()) for name in self.columns}
        rows: dict[str, list] = {name: [] for name in wanted}
        held = count = 0
        for name in partition.names:
            with system.open_input_file(name) as file:
                for found in self._records(file):
                    for column in wanted:
                        rows[column].append(found.get(column))
                    held += len(found.get("payload") or b"")
                    count += 1
                    if held >= BATCH_BYTES or count >= 4096:
                        yield self._batch(rows, wanted)
                        rows = {name: [] for name in wanted}
                        held = count = 0
        if count:
            yield self._batch(rows, wanted)

    @staticmethod
    def _batch(rows: dict[str, list], wanted: dict[str, pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[name], kind) for name, kind in wanted.items()], names=list(wanted))

    def _records(self, file) -> Iterator[dict]:
        start, size = 0, file.size()
        while start < size:
            one = _Member(file, start)
            if one.ended:
                raise ValueError(f"no gzip member at byte {start}")
            stop = one.upto(_END)
            if stop < 0:
                raise ValueError(f"no WARC header at byte {start}")
            found, length, is_http = parse_head(one.out[:stop])
            if _passes(self.filters, found):
                if "payload_bytes" in self.columns or "payload" in self.columns:
                    self._add_payload(one, found, stop + len(_END), length, is_http)
                yield found
            start = one.next_start()


    def _add_payload(self, one: _Member, found: dict, body: int, length: int, is_http: bool) -> None:
        """The block without its HTTP header is the payload; a revisit's is elsewhere, as long as its header says."""
        http = one.upto(_END, body) if is_http else -1
        begin = body if not is_http else http + len(_END) if 0 <= http <= body + length - len(_END) else body + length
        if found["record_type"] == "revisit":
            told = _fields(one.out[body:begin]).get("content-length", "")
            found["payload_bytes"] = int(told) if told.isdigit() else None
            return
        found["payload_bytes"] = body + length - begin
        if "payload" in self.columns:
            found["payload"] = one.whole()[begin : body + length]


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = open_folder(self.path)
        place = f"{folder}/_temporary/{self.job}"
        system.create_dir(place, recursive=True)
        names: list[str] = []
        file, written = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if file is None or written >= FILE_BYTES:
                        if file is not None:
                            file.close()
                        names.append(f"{place}/{uuid.uuid4().hex}.warc.gz")
                        file, written = system.open_output_stream(names[-1], compression=None), 0
                    packed = member(record_bytes(row))
                    file.write(packed)
                    written += len(packed)
        finally:
            if file is not None:
                file.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = open_folder(self.path)
        if self.overwrite:
            for one in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if one.is_file and one.base_name.endswith(".warc.gz"):
                    system.delete_file(one.path)
        system.create_dir(folder, recursive=True)
        for number, message in enumerate(messages):
            for roll, name in enumerate(message.names if message else []):
                system.move(name, f"{folder}/part-{self.job[:8]}-{number:05d}-{roll:03d}.warc.gz")
        self._clear(system, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*open_folder(self.path))

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        place = f"{folder}/_temporary/{self.job}"
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Records to write: of equal payloads of some size the smallest id is the response, others revisit it.

    Rows with one id and payload are each the response; a null id never is if
    another id has the payload.  Digests alone tell which payloads may repeat; only
    the payloads of those that do, and of few others, are shuffled, and none of a
    digest that very many pages share.
    """
    def shaped(*names):
        whole = F.coalesce(F.col(f"`{html_column}`"), F.lit("")).cast("binary")
        found = pages.select(
            F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("target_uri"), whole.alias("payload"),
            F.sha2(whole, 256).alias("payload_digest"), F.octet_length(whole).cast("long").alias("payload_bytes"),
        )
        return found.select(*names) if names else found

    narrow = written(shaped("page_id", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= SMALLEST_REVISIT), "payload-digests")
    total = narrow.count()
    blocks = exact_dedup.blocks_for(total)
    bits = written(exact_dedup.repeated_bits(narrow, "payload_digest", blocks), "repeated-digests")
    groups = exact_dedup.flagged(narrow, "payload_digest", bits, blocks, "maybe").filter("maybe").groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("members")
    )
    rows = exact_dedup.flagged(shaped(), "payload_digest", bits, blocks, "maybe")
    rows = rows.withColumn("maybe", F.col("maybe") & (F.col("payload_bytes") >= SMALLEST_REVISIT))
    alone = rows.filter("NOT maybe").withColumns({"first": F.col("page_id"), "members": F.lit(1).cast("long")})
    met = alone.unionByName(with_group_facts(rows.filter("maybe"), groups, "payload_digest", "members", total))
    again = (F.col("members") > 1) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def urn(value):
        return F.concat(F.lit("urn:page:"), F.coalesce(value.cast("string"), F.lit("none")))

    return met.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_of(record_id):
    """The id in a record id that ``records`` made."""
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("long")
