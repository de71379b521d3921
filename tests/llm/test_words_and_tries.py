"""Byte-level BPE, conversation tries and periodic runs: small cases and brute force."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gleaner.llm import arrays, byte_pairs, common, conversation_trie, periodic_runs

FOLDER = os.environ.get("GLEANER_TEST_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
WORD = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def prepared(spark):
    return common.prepared(spark)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def texts(spark, *rows):
    """Documents with columns whose names the operators use themselves."""
    kind = "doc_id long, text string, ids string, value int, ROW string, block int, Runs string"
    return spark.createDataFrame([(*row, *["x", 1, "r", 2, "q"]) for row in rows], kind)


@pytest.mark.parametrize("most", [1, 127, 128, 16_383, 1 << 40])
def test_varints(most):
    values = np.random.default_rng(most).integers(0, most + 1, 500)
    packed, sizes = arrays.varints(values)
    assert (arrays.from_varints(packed.tobytes()) == values).all() and sizes.sum() == len(packed)
    assert len(arrays.from_varints(b"")) == 0


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding(
        "own", pat_str=byte_pairs.default_pattern(), mergeable_ranks=byte_pairs.ranks(byte_pairs.default_path()), special_tokens={}
    )


def test_merges_of_single_words(library):
    ranked, draw = byte_pairs.ranks(byte_pairs.default_path()), random.Random(5)
    for size in [1, 2, 3, 8, 30, 199, 200, 201, 500, 4000]:
        for _ in range(40 if size < 300 else 4):
            word = "".join(draw.choice("aabeehnst" if size % 2 else "aeéßжю中") for _ in range(size))
            assert byte_pairs.merge(word.encode(), ranked) == library.encode_ordinary(word)


STRANGE = [
    None, "", " ", "\n", "  \n\t  ", "It's they're we'll 'S", "a  b   c", "x y z", "éÉß 中文字 жизнь", "１２３ 42", "👩‍👩‍👧 ok", "\x00\x1c\x1f", "<|endoftext|>",
    "a" * 5000, "ab" * 900, " " * 3000, LONG, "same words here", "same words here", "\r\n\r\n end ",
]


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("block", [1, 200, 1 << 24])
def test_ids_as_the_library_has_them(prepared, library, monkeypatch, tmp_path, parts, block):
    monkeypatch.setattr(byte_pairs, "BLOCK_BYTES", block)
    frame = texts(prepared, *enumerate(STRANGE), (None, "no id"), (3, "again"), (3, "again")).repartition(parts)
    frame.write.parquet(f"{tmp_path}/docs")
    frame = prepared.read.parquet(f"{tmp_path}/docs")
    encoded = byte_pairs.encode(frame)
    assert encoded.columns == ["doc_id", "value", "ROW", "block", "Runs", "ids"]
    rows = encoded.collect()
    want = sorted((repr(row.doc_id), library.encode_ordinary(row.text or "")) for row in frame.collect())
    assert sorted((repr(row.doc_id), row.ids) for row in rows) == want and all(row.ROW == "r" and row.value == 1 for row in rows)
    decoded = byte_pairs.decode(encoded).collect()
    assert sorted((repr(row.doc_id), bytes(row.decoded)) for row in decoded) == sorted((repr(r.doc_id), (r.text or "").encode()) for r in frame.collect())


def test_the_latin_pattern_splits_alike():
    import regex

    pattern, draw = byte_pairs.default_pattern(), random.Random(3)
    latin, plain = byte_pairs._latin(pattern), regex.compile(pattern)
    every = [chr(point) for point in range(byte_pairs._LATIN)]
    for letters in (every, list("aé'stvrel 12²\t\n\x1c\x85\xa0.-")):
        for _ in range(400):
            text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
            assert latin.findall(text) == plain.findall(text)
    assert byte_pairs._latin(r"\d+") is None and byte_pairs._latin(r"\w+|[^\S]") is None


def test_words_are_encoded_once(prepared, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BLOCK_BYTES", 50)
    frame = prepared.createDataFrame([(i, "common word of all, and one" + str(i % 7) * 3) for i in range(400)], "doc_id long, text string").repartition(4)
    words = frame.select("text", "doc_id").withColumn("part", F.spark_partition_id())
    packed = words.mapInArrow(byte_pairs._words_of(byte_pairs.default_pattern(), 64), byte_pairs._WORDS).collect()
    places = {}
    for row in packed:
        edges = np.cumsum(arrays.from_varints(bytes(row["sizes"]))).tolist()
        for a, b in zip([0, *edges], edges):
            places.setdefault(bytes(row["words"])[a:b], set()).add(row["bucket"])
    assert all(len(buckets) == 1 for buckets in places.values()) and b" common" not in places and b"common" in places


def test_bpe_of_nothing_and_of_odd_ids(prepared):
    frame = texts(prepared, (1, "a"))
    empty = byte_pairs.encode(frame.limit(0))
    assert empty.count() == byte_pairs.decode(empty).count() == 0
    only = byte_pairs.encode(frame.select("text"))
    assert only.columns == ["ids"] and len(only.first().ids) == 1
    given = prepared.createDataFrame([(1, None), (2, []), (3, [0, 0])], "doc_id long, ids array<int>")
    assert [None if r.decoded is None else len(r.decoded) for r in byte_pairs.decode(given).orderBy("doc_id").collect()] == [None, 0, 2]
    with pytest.raises(PythonException, match="no token has the id 60000"):
        byte_pairs.decode(prepared.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")).collect()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_bpe_query(spark, library):
    found = {row.doc_id: row for row in contract.queries()["op12_byte_bpe"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(docs) == len(found)
    for row in docs:
        ids = library.encode_ordinary(row.text or "")
        assert tuple(found[row.doc_id])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(row.text or ""))


# periodic runs


def brute_runs(words, least=12):
    found = set()
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at < len(words) - period:
            stop = at
            while stop < len(words) - period and words[stop] == words[stop + period]:
                stop += 1
            if stop + period - at >= max(least, 2 * period):
                smaller = any(all(words[i] == words[i + d] for i in range(at, stop + period - d)) for d in range(1, period))
                if not smaller:
                    found.add((at, stop + period - at, period))
            at = max(stop, at + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(60):
        docs, least = [], draw.choice([12, 12, 4, 7, 20])
        for _ in range(draw.randint(1, 6)):
            words = [f"w{draw.randrange(draw.choice([1, 2, 3, 30]))}" for _ in range(draw.randint(0, 80))]
            for _ in range(draw.randint(0, 3)):
                if len(words) > 4:
                    start, period = draw.randrange(len(words)), draw.randint(1, 12)
                    for i in range(start + period, min(len(words), start + draw.randint(1, 60))):
                        words[i] = words[i - period]
            docs.append(words)
        runs, short = periodic_runs._chunk([" ".join(words).encode() for words in docs], least)
        for words, got, text in zip(docs, runs.to_pylist(), short.to_pylist()):
            want = brute_runs(words, least)
            assert [(r["start"], r["length"], r["period"]) for r in got] == want and text == collapsed(words, want)


def test_runs_of_small_cases(prepared):
    cases = {
        1: None, 2: "", 3: " \n\t ", 4: "a " * 11, 5: "a " * 12, 6: "a b c d e f " * 2, 7: "a b c d e f g " * 2 + "a", 8: "x y " * 12,
        9: "p q " * 40 + LONG, 10: "a " * 30 + "b " * 30, 11: ("a b " * 6 + "c ") * 2,
    }
    frame = texts(prepared, *cases.items(), (None, "z " * 20), (5, "a " * 12))
    found = periodic_runs.periodic_runs(frame)
    assert found.columns == ["doc_id", "text", "ids", "value", "ROW", "block", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == 13
    for row in rows:
        words = re.findall(WORD, row.text or "")
        got = [tuple(run) for run in row.runs]
        if row.doc_id == 9:
            # the first words, and the long part of period 977
            assert got[0] == (0, 80, 2) and got[-1][1:] == (30_000, 977)
        else:
            assert got == brute_runs(words)
        assert row.collapsed == collapsed(words, got)
    assert periodic_runs.periodic_runs(frame.limit(0)).count() == 0


def test_runs_of_words_of_one_kind_and_fibonacci_words():
    a, b = "a", "ab"
    for _ in range(8):
        a, b = b, b + a
    runs, _ = periodic_runs._chunk([" ".join(b).encode()], 12)
    assert [(r["start"], r["length"], r["period"]) for r in runs.to_pylist()[0]] == brute_runs(list(b))
    runs, text = periodic_runs._chunk([b"a " * 100_000, b"a b " * 50_000], 12)
    assert [[tuple(r.values()) for r in one] for one in runs.to_pylist()] == [[(0, 100_000, 1)], [(0, 100_000, 2)]] and text.to_pylist() == ["a", "a b"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_runs_query(spark):
    found = {row.doc_id: row for row in contract.queries()["op13_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(found) == len(docs)
    for row in docs:
        words = re.findall(WORD, row.text or "")
        n, hashed = len(words), zlib.crc32(str(row.doc_id).encode())
        if hashed % 10 == 0 and n:
            g = hashed // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        if n > 1200:
            continue
        runs = brute_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        facts = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        assert tuple(found[row.doc_id])[1:] == (len(runs), *facts, sha(lines), sha(collapsed(words, runs)))


# conversation tries


def brute_trie(conversations):
    """Nodes from lists of (role, text) by conversation."""
    members, words = {}, {}
    for one, said in conversations.items():
        for depth in range(len(said) + 1):
            members.setdefault(tuple(said[:depth]), []).append(one)
    for node in members:
        words[node] = len(re.findall(WORD, node[-1][1])) if node else 0
    rows = set()
    for node, inside in members.items():
        below = [other for other in members if other[: len(node)] == node]
        children = [other for other in below if len(other) == len(node) + 1]
        leaves = [other for other in below if not any(o[: len(other)] == other and len(o) > len(other) for o in members)]
        ends = ",".join(map(str, sorted(one for one in inside if len(conversations[one]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        saved = sum((len(members[other]) - 1) * words[other] for other in below)
        rows.add((min(inside), len(node), parent, len(inside), len(children), len(leaves), saved, sha(ends)))
    return rows


def said(spark, rows):
    return spark.createDataFrame([(*row, None, "x", 7) for row in rows], "conv_id long, turn long, role string, text string, id int, digest string, position int")


def in_order(rows):
    conversations = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for row in sorted((row for row in rows if row[0] is not None), key=order):
        conversations.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return conversations


@pytest.mark.parametrize("seed", range(3))
def test_tries_against_brute_force(prepared, seed):
    draw = random.Random(seed)
    pool, rows = [], []
    for one in range(60):
        turns = list(draw.choice(pool)) if pool and draw.random() < 0.8 else []
        turns = turns[: draw.randint(0, len(turns))] + [(draw.choice(["user", "bot"]), "hi " * draw.randint(0, 4)) for _ in range(draw.randint(0, 7))]
        pool.append(turns)
        rows += [(one - 20, i, role, text) for i, (role, text) in enumerate(turns)]
    found = conversation_trie.prefix_trie(said(prepared, rows)).collect()
    assert {tuple(row) for row in found} == (want := brute_trie(in_order(rows))) and len(found) == len(want)


def test_tries_of_nulls_ties_copies_and_long_conversations(prepared, monkeypatch):
    monkeypatch.setattr(conversation_trie, "_PIECE_BITS", 2)
    rows = [(1, None, "a", "first"), (1, 0, None, None), (1, 0, None, None), (1, 5, "a", "tie one"), (1, 5, "a", "tie two"), (None, 1, "a", "nobody's")]
    rows += [(2, None, "a", "first"), (2, 0, "", "")]
    rows += [(c, i, "u", text) for c in range(3, 40) for i, text in enumerate(["same words", "in all", "of them", "up to", "here"])]
    rows += [(c, 5, "u", f"own {c % 3}") for c in range(3, 40, 2)]
    rows += [(50, i, "u", "same words" if i == 0 else f"t {i % 9}") for i in range(400)]
    found = conversation_trie.prefix_trie(said(prepared, rows)).collect()
    assert {tuple(row) for row in found} == (want := brute_trie(in_order(rows))) and len(found) == len(want)
    assert conversation_trie.prefix_trie(said(prepared, rows).limit(0)).count() == 0


def test_large_groups_meet_their_facts_by_broadcast(prepared, monkeypatch):
    hot = lambda rows, groups, key, size, total: common.with_group_facts(rows, groups, key, size, total, 3)
    monkeypatch.setattr(conversation_trie, "with_group_facts", hot)
    rows = [(c, i, "u", f"t {i} {c % (i + 1)}") for c in range(40) for i in range(c % 9)]
    found = conversation_trie.prefix_trie(said(prepared, rows)).collect()
    assert {tuple(row) for row in found} == brute_trie(in_order(rows))


@pytest.mark.parametrize("rows", [[], [(1, 0, "u", "only")], [(5, 0, "u", "a"), (25, 0, "u", "b"), (40, 0, "u", "c"), (45, 0, "u", "c"), (45, 1, "u", "d")]])
def test_rebuilt_conversations(prepared, tmp_path, rows):
    said(prepared, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    found = contract.queries()["op11_conversation_trie"](prepared, str(tmp_path)).collect()
    own, rebuilt = in_order(rows), {}
    for one, turns in own.items():
        head = zlib.crc32(str(one).encode()) % 4
        rebuilt[one] = own.get(one - one % 20, [])[:head] + turns[head:]
    assert {tuple(row) for row in found} == brute_trie(rebuilt)
