"""The registered corpus queries: beside their twins, or beside brute force where SQL can't say it."""

import os
import re
import zlib
from collections import defaultdict

import pytest
import twins

import __spark_entry__ as contract
import corpus_pipeline
from gleaner.llm import queries, sentence_pieces, token_files

FOLDER = os.environ.get("GLEANER_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    assert twins.compare(spark, name, FOLDER) > 0


def test_every_operator_is_registered():
    names = set(contract.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in names} and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]


def test_sentencepiece_gives_back_every_text(spark):
    rows = contract.queries()["op2_sentencepiece"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(row.exact for row in rows)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = contract.queries()["op3_language_id"](spark, FOLDER).join(docs, "doc_id").filter("held_out").collect()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) and 0 <= row.score <= 1 for row in rows)
    assert sum(row.lang == row.lang_pred for row in rows) >= 0.97 * len(rows)


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_path())
    found = {row.doc_id: row for row in contract.queries()["op5_token_files"](spark, FOLDER).collect()}
    start = 0
    for row in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert tuple(found[row.doc_id]) == (row.doc_id, start, len(ids), zlib.crc32(raw))
        start += len(ids)


def _shingles(text, width, words):
    words = words(text)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))}


def test_pipeline_against_brute_force(spark):
    docs = {row.doc_id: row for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    lower = lambda text: re.sub("[A-Z]", lambda m: m[0].lower(), text)
    kept = {i: row.text for i, row in docs.items() if any(c.isalpha() for c in row.text or "")}
    last = {lower(text): i for i, text in sorted(kept.items())}
    kept = {i: kept[i] for i in last.values()}
    sets = {i: _shingles(lower(text), 5, lambda t: re.findall("[^\x20\x09-\x0d]+", t)) for i, text in kept.items()}
    holders = defaultdict(set)
    for i, one in sets.items():
        for shingle in one:
            holders[shingle].add(i)
    root = {i: i for i in kept}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in sets.items():
        for j in {j for shingle in one for j in holders[shingle] if j > i}:
            if 100 * len(one & sets[j]) >= 80 * len(one | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    tests = [one for one in (_shingles(item.text or "", 5, words) for item in items) if one]
    clean = set()
    for i in kept:
        own = _shingles(kept[i], 5, words)
        if top(i) == i and not any(100 * len(one & own) >= 80 * len(one) for one in tests):
            clean.add(i)
    result = sentence_pieces.decode(contract.queries()["pipeline"](spark, FOLDER)).collect()
    assert {row.doc_id for row in result} == clean and len(result) == len(clean)
    assert all(row.decoded == docs[row.doc_id].text and row.n_pieces == len(row.pieces) for row in result)
