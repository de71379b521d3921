"""The registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    byte_pairs, conversation_trie, decontaminate, exact_dedup, language, near_dedup, periodic_runs, secret_scan, sentence_pieces, sharding, token_files, url_filter,
    warc,
)
from gleaner.llm.common import prepared, with_group_facts
from gleaner.session import shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

SHARDS = 24


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = lambda spark, sf_dir: function(prepared(spark), sf_dir)
        if sql is not None:
            _ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
    FROM (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
    WINDOW same AS (PARTITION BY text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


# CRC-32 in SQL: the table of 256 remainders is made by rule, then folded over the bytes
_REMAINDERS_SQL = """
    remainders AS (
        SELECT list(r ORDER BY i) AS t
        FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                     lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) s(i))
    ),
"""
_CRC_SQL = f"""
    {_REMAINDERS_SQL}
    sums AS (
        SELECT text, xor(4294967295, list_reduce(
                   list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
        FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), remainders
    )
"""


@_query(f"""
    WITH {_CRC_SQL},
    sized AS (
        SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size,
               ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key
        FROM documents
    ),
    dealt AS (
        SELECT *, floor((sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size)::HUGEINT * {SHARDS}
                        // sum(size) OVER ())::INT AS shard
        FROM sized
    )
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
    FROM dealt JOIN sums USING (text)
""")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@_query(f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                       ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
        FROM words
    ),
    single AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM single a JOIN single b ON a.g = b.g AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON r.other = w.a
    )
    SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
""")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@_query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    model = language.train(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return language.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


@_query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    there_and_back = sentence_pieces.decode(sentence_pieces.encode(docs).drop("text"))
    return there_and_back.select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"),
        F.crc32(F.array_join("pieces", " ").cast("binary")).alias("pieces_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("exact"),
    )


@_query(r"""
    WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
    words AS (
        SELECT kind, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM texts
    ),
    sets AS (
        SELECT kind, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
        FROM words
    ),
    single AS (SELECT kind, id, len(s) AS n, unnest(s) AS g FROM sets)
    SELECT d.id AS doc_id, i.id AS item_id, i.n AS n_item, count(*) AS n_common
    FROM single d JOIN single i ON d.kind = 'd' AND i.kind = 'i' AND d.g = i.g
    GROUP BY d.id, i.id, i.n HAVING 100 * count(*) >= 80 * i.n
""")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_common")


def _secret_twin() -> str:
    """Spans by the lengths of matches and gaps, weak kinds by plain pairs within the scope."""
    kinds = secret_scan.KINDS
    quoted = [kind.pattern.replace("'", "''") for kind in kinds]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS matches FROM texts"
        for i, p in enumerate(quoted)
    )
    listed = lambda role: ", ".join(str(i) for i, kind in enumerate(kinds) if kind.role == role)
    near = lambda role: (
        f"EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = w.doc_id AND s.kind IN ({listed(role)}) "
        f"AND s.start - w.stop <= {secret_scan.SCOPE} AND w.start - s.stop <= {secret_scan.SCOPE})"
    )
    weak = " OR ".join(
        f"(kind = {i} AND {' AND '.join(near(role) for role in kind.needs)})" for i, kind in enumerate(kinds) if kind.needs
    )
    names = ", ".join(f"'{kind.name}'" for kind in kinds)
    text = f"[{names}][kind + 1] || ':' || start || ':' || stop"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({found}),
    steps AS (SELECT doc_id, kind, unnest(range(1, len(matches) + 1)) AS i, gaps, matches FROM found WHERE len(matches) > 0),
    placed AS (
        SELECT doc_id, kind, matches[i] AS m, sum(len(gaps[i]) + len(matches[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM steps
    ),
    spans AS (
        SELECT doc_id, kind, (stop - len(m))::BIGINT AS start, stop::BIGINT AS stop FROM placed
        WHERE CASE kind WHEN 0 THEN len(regexp_extract(m, '{quoted[0]}', 2)) >= 6 WHEN 1 THEN len(m) >= 20
              WHEN 3 THEN len(m) = 40 AND NOT regexp_full_match(m, '[0-9a-f]+') ELSE true END
    ),
    told AS (SELECT * FROM spans WHERE kind < {secret_scan.BASE} UNION ALL SELECT * FROM spans w WHERE {weak})
    SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           sha256(coalesce(string_agg({text}, ',' ORDER BY start, kind) FILTER (kind < {secret_scan.BASE}), '')) AS base_sha256,
           coalesce(string_agg({text}, ',' ORDER BY start, kind) FILTER (kind IS NOT NULL), '') AS spans
    FROM documents LEFT JOIN told USING (doc_id) GROUP BY doc_id
    """


@_query(_secret_twin())
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.digests(docs, secret_scan.scan(docs))


@_query()
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, end_id=2)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@_query("""
    WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    led AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM sized)
    SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM led
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    folder = shared_folder(spark, "warc")
    warc.records(_table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    page, first = warc.page_of(F.col("record_id")).alias("page_id"), warc.page_of(F.col("refers_to")).alias("refers_to")
    whole = spark.read.format("warc").load(folder).filter("record_type = 'response'")
    told = spark.read.format("warc").schema(
        "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long"
    ).load(folder).filter("record_type = 'revisit'")
    return whole.select(page, "payload_bytes", F.sha2("payload", 256).alias("payload_digest"), "record_type", first).unionByName(
        told.select(page, "payload_bytes", "payload_digest", "record_type", first)
    )


# Captures and dated lists made from the addresses of all pages: a page is fetched on a
# day told by its id, and hashes of its host say what is listed, when, and for how long.
_FETCHED = "timestamp '2024-01-01 06:00:00' + make_interval(0, 0, 0, cast(page_id % 730 AS int))"
_CHANGES = """
    WITH hosts AS (SELECT DISTINCT host, cast(conv(substr(md5(host), 1, 7), 16, 10) AS int) AS h FROM addresses),
    days AS (
        SELECT 'hosts' AS list_name, 'host' AS kind, host AS value, 'add' AS action, h % 500 AS day FROM hosts WHERE h % 3 = 0
        UNION ALL SELECT 'hosts', 'host', host, 'remove', h % 500 + 120 FROM hosts WHERE h % 3 = 0
        UNION ALL SELECT 'domains', 'domain', regexp_replace(host, '^(blog|m)[.]', ''), 'add', h % 700 FROM hosts WHERE h % 5 = 0
        UNION ALL SELECT 'sections', 'prefix', concat(host, '/en/'), 'add', h % 90 + 200 * n FROM hosts LATERAL VIEW explode(array(0, 1, 2)) v AS n WHERE h % 4 = 0
        UNION ALL SELECT 'sections', 'prefix', concat(host, '/en/'), 'remove', h % 90 + 200 * n + 50 FROM hosts LATERAL VIEW explode(array(0, 1, 2)) v AS n WHERE h % 4 = 0
        UNION ALL SELECT 'pages', 'url', concat(host, path), 'add', cast(page_id % 700 AS int) FROM addresses WHERE page_id % 50 = 0
    )
    SELECT list_name, kind, value, action, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, day) AS effective_at FROM days
"""


@_query("""
    WITH addresses AS (
        SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host,
               regexp_extract(regexp_replace(url, '#.*$', ''), '^https?://[^/?#]+(/.*)$', 1) AS path, page_id % 730 + 0.25 AS day
        FROM pages
    ),
    hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 7))::INT AS h FROM addresses),
    spans AS (
        SELECT DISTINCT 'hosts' AS list_name, 'host' AS kind, host AS value, h % 500 AS a, h % 500 + 120 AS b FROM hosts WHERE h % 3 = 0
        UNION SELECT 'domains', 'domain', regexp_replace(host, '^(blog|m)[.]', ''), min(h % 700), 99999 FROM hosts WHERE h % 5 = 0 GROUP BY 1, 2, 3
        UNION SELECT 'sections', 'prefix', host || '/en/', h % 90 + 200 * n, h % 90 + 200 * n + 50 FROM hosts, range(3) t(n) WHERE h % 4 = 0
        UNION SELECT 'pages', 'url', host || path, min(page_id % 700), 99999 FROM addresses WHERE page_id % 50 = 0 GROUP BY 1, 2, 3
    ),
    told AS (
        SELECT page_id, list_name, kind, value FROM addresses p JOIN spans s ON day >= a AND day < b AND CASE kind
            WHEN 'host' THEN host = value WHEN 'url' THEN host || path = value WHEN 'prefix' THEN starts_with(host || split_part(path, '?', 1), value)
            ELSE host = value OR ends_with(host, '.' || value) END
    )
    SELECT page_id, count(value) > 0 AS blocked, count(value) AS n_entries,
           coalesce(string_agg(DISTINCT list_name, ',' ORDER BY list_name), '') AS lists
    FROM pages LEFT JOIN told USING (page_id) GROUP BY page_id
""")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_FETCHED).alias("fetched_at"))
    parts = url_filter.address(F.col("url"))
    addresses = pages.select("page_id", parts["host"].alias("host"), parts["path"].alias("path"))
    changes = spark.sql(_CHANGES.replace("addresses", "{addresses}"), addresses=addresses)
    return url_filter.judge(pages, changes).select("page_id", "blocked", "n_entries", "lists")


@_query()
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_pairs.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids",
    )
    return byte_pairs.decode(encoded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


# In one document of ten the words from some place on repeat with a period that doc_id tells.
_CONTINUED = r"""
    CASE WHEN crc32(cast(doc_id AS string)) % 10 = 0 THEN
        transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), words ->
            transform(array(named_struct('g', crc32(cast(doc_id AS string)) div 10, 'n', greatest(size(words), 1))), v ->
                transform(array(named_struct('a', v.g % v.n, 'p', 1 + (v.n - v.g % v.n) div (3 + v.g % 8))), w ->
                    array_join(transform(words, (word, i) -> IF(i < w.a, word, get(words, cast(w.a + (i - w.a) % w.p AS int)))), ' ')
                )[0])[0])[0]
    ELSE text END
"""


@_query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_CONTINUED).alias("text"))
    found = periodic_runs.periodic_runs(docs).drop("text")
    # the longest run, the first of equals
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.array_join(listed, "").alias("lines")).select(
        "doc_id", "n_runs", (-F.col("top.col2")).alias("start"), F.col("top.length"), (-F.col("top.col3")).alias("period"),
        F.expr("1000 * top.length div -top.col3").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _with_heads(own: DataFrame) -> DataFrame:
    """Every conversation c as the first turns of conversation c - c % 20 and its own turns after as many; its id tells how many."""
    heads = own.filter("conv_id % 20 = 0 AND position < 3").groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("position", "digest", "words"))).alias("head")
    )
    told = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left").select(
        "conv_id", "n", F.expr("cast(crc32(cast(conv_id AS string)) % 4 AS int) AS h"), "head"
    )
    told = told.withColumn("head", F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(array(named_struct('position', 0L, 'digest', X'', 'words', 0L)), 1, 0)")))
    facts = told.select("conv_id", "n", "h", F.size("head").alias("m"))
    rest = with_group_facts(own, facts, "conv_id", "n", own.count()).filter("position >= h").select(
        "conv_id", F.expr("position - h + m AS position"), "digest", "words"
    )
    return told.select("conv_id", F.inline("head")).unionByName(rest)


@_query(rf"""
    WITH RECURSIVE {_REMAINDERS_SQL}
    placed AS (
        SELECT conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), digest) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    ids AS (
        SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
                   list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM placed), remainders
    ),
    heads AS (SELECT i.conv_id, p.pos, p.digest, p.text FROM ids i JOIN placed p ON p.conv_id = i.base AND p.pos < i.h),
    rebuilt AS (
        SELECT * FROM heads UNION ALL
        SELECT i.conv_id, p.pos - i.h + coalesce(m, 0), p.digest, p.text
        FROM ids i JOIN placed p ON p.conv_id = i.conv_id AND p.pos >= i.h LEFT JOIN (SELECT conv_id, count(*) AS m FROM heads GROUP BY ALL) s ON s.conv_id = i.conv_id
    ),
    prefixes AS (
        SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS words FROM ids UNION ALL
        SELECT conv_id, pos + 1, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM rebuilt
    ),
    nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM prefixes GROUP BY prefix, depth),
    ups AS (SELECT n.*, p.prefix AS parent FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
    fans AS (SELECT parent AS prefix, count(*) AS n_children FROM ups WHERE parent IS NOT NULL GROUP BY parent),
    below AS (
        SELECT p.prefix, count(*) FILTER (f.prefix IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens
        FROM nodes v LEFT JOIN fans f USING (prefix) JOIN prefixes p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.prefix
    ),
    ends AS (
        SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
        FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS length FROM prefixes) WHERE depth = length GROUP BY prefix
    )
    SELECT u.conv_id, u.depth, up.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
           coalesce(ends_sha256, sha256('')) AS ends_sha256
    FROM ups u LEFT JOIN nodes up ON up.prefix = u.parent LEFT JOIN fans f ON f.prefix = u.prefix
         JOIN below b ON b.prefix = u.prefix LEFT JOIN ends e ON e.prefix = u.prefix
""")
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_trie.turns(_table(spark, sf_dir, "conversations"))
    rebuilt = written(_with_heads(own), "rebuilt-turns")
    return conversation_trie.trie(rebuilt, own.select("conv_id").distinct())
