"""State tables derived by Spark from the driver tables.

The derived tables grow with the given ones; ``oracle_tables.py`` states the same
rules in SQL.  The log and state tables are stored once per application, as a
deployment holds them, so that queries scan them with pushed-down filters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.session import shared_folder

STATUSES = ["queued", "running", "succeeded", "failed", "skipped_out_of_range"]
CONTENT_TYPES = ["technical_article", "engineering_case", "research_article", "research_reflection", "learning_path",
                 "personal_reflection", "career_experience", "tooling_note"]


_stored: dict[tuple[str, str, str], tuple[str, StructType]] = {}
_lock = RLock()


def stored(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Derive a table on first use and read the written copy from then on."""

    @wraps(build)
    def table(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        with _lock:
            if key not in _stored:
                folder, frame = shared_folder(spark, f"state-{build.__name__}"), build(spark, sf)
                frame.write.parquet(folder)
                _stored[key] = (folder, frame.schema)
        folder, schema = _stored[key]
        return spark.read.schema(schema).parquet(folder)

    return table


def derive_all(spark: SparkSession, sf: str) -> None:
    """Store every state table now."""
    for table in (articles, fetches, evaluations, failures, vocabulary, links):
        table(spark, sf)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ts(name: str) -> Column:
    """Zone-less times of the driver tables are UTC."""
    return F.col(name).cast("timestamp")


def days(n: Column | int) -> Column:
    return F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def source_name() -> Column:
    """One source holds more than a third of all articles."""
    return F.when(F.col("o_custkey") % 3 == 0, F.lit("src0")).otherwise(
        F.concat(F.lit("src"), (F.col("o_custkey") % 50).cast("string"))
    )


@stored
def articles(spark: SparkSession, sf: str) -> DataFrame:
    key, date = F.col("o_orderkey"), ts("o_orderdate")
    path = F.concat(source_name(), F.lit("/"), key.cast("string"))
    status = (
        F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "candidate")
        .otherwise("rejected")
    )
    return read(spark, sf, "orders").select(
        key.alias("id"),
        source_name().alias("source_name"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), (key % 1000).cast("string")).alias("title"),
        F.concat(F.when(key % 5 == 0, "HTTPS://Example.com:443/").otherwise("https://example.com/"), path).alias("url"),
        F.concat(F.lit("https://example.com/"), path).alias("normalized_url"),
        F.concat(source_name(), F.lit("-"), key.cast("string")).alias("slug"),
        status.alias("status"),
        (key % 5).cast("int").alias("retry_count"),
        F.when(key % 7 != 0, date).alias("published_at"),
        F.when((F.col("o_orderstatus") == "F") & (key % 11 != 0), date + days(2)).alias("collected_at"),
        (date - days(1)).alias("created_at"),
        (date + days((key % 30).cast("int"))).alias("updated_at"),
        F.when(key % 13 == 0, F.lit("old error")).alias("error"),
        F.array(F.lower(F.substring("o_orderpriority", 3, 20))).alias("source_tags"),
        F.when(key % 4 == 0, F.lit("kept text")).alias("source_content"),
        F.lit(None).cast("map<string,string>").alias("source_content_metadata"),
    )


# rows a task numbers: some 30 MB in memory, so that its sort never spills however large the table is
NUMBERED_ROWS = 250_000


@stored
def log_base(spark: SparkSession, sf: str) -> DataFrame:
    """All line items as log rows.  Pairs of article and line repeat in the data: their rows are numbered, below 1,001 each."""
    fields, pair = ["l_shipdate", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"]
    items = read(spark, sf, "lineitem").select(*pair, *fields)
    tasks = max(items.count() // NUMBERED_ROWS + 1, spark.sparkContext.defaultParallelism)
    nth = F.row_number().over(Window.partitionBy(*pair).orderBy(*fields))
    return items.repartition(tasks, *pair).select(
        "l_orderkey", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1001 + nth - 1).alias("id"), *fields
    )


@stored
def fetches(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.col("l_linestatus") == "F"
    text = F.concat(
        F.lit(" body of part "), F.col("l_partkey").cast("string"), F.lit(" from "), F.col("l_suppkey").cast("string"),
        F.lit("\n"),
    )
    return log_base(spark, sf).filter("l_returnflag = 'A'").select(
        "id",
        F.col("l_orderkey").alias("article_id"),
        ts("l_shipdate").alias("fetched_at"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(~failed, text).alias("content"),
        F.when(failed, F.concat(F.lit("timeout "), F.col("l_suppkey").cast("string"))).alias("error"),
        F.when(~failed & (F.col("l_partkey") % 3 == 0), ts("l_shipdate") - days(30)).alias("published_at"),
    )


@stored
def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    part = read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    rows = log_base(spark, sf).filter("l_returnflag = 'N'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        "id",
        F.col("l_orderkey").alias("article_id"),
        ts("l_shipdate").alias("evaluated_at"),
        pick(["accept", "reject", "low_confidence"], F.col("l_suppkey") % 3).alias("decision"),
        pick(CONTENT_TYPES, F.col("l_partkey") % 8).alias("content_type"),
        F.concat(F.lit(" summary "), F.col("l_partkey").cast("string")).alias("summary"),
        F.array(words[0], words[1], F.upper(words[0]), F.lit(" ")).alias("tags"),
        F.array(F.concat(words[1], F.lit("  Topic")), F.col("p_brand"), words[0]).alias("suggested_tags"),
        F.concat(F.lit("reason "), F.col("l_suppkey").cast("string")).alias("recommendation_reason"),
        F.concat(F.lit("model-"), (F.col("l_suppkey") % 2).cast("string")).alias("model_name"),
    )


@stored
def failures(spark: SparkSession, sf: str) -> DataFrame:
    return log_base(spark, sf).filter("l_returnflag = 'R'").select(
        "id",
        F.col("l_orderkey").alias("article_id"),
        ts("l_shipdate").alias("failed_at"),
        F.concat(F.lit("invalid reply "), F.col("l_suppkey").cast("string")).alias("error"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("attempts"),
        F.lit(None).cast("string").alias("raw_response"),
    )


@stored
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Words of part names; every other one is disabled."""
    start = F.lit("2020-01-01 00:00:00").cast("timestamp")
    words = read(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    return words.groupBy("word").agg(F.min(F.col("p_partkey") * 10 + F.col("at")).alias("id")).select(
        "id",
        F.initcap("word").alias("name"),
        F.col("word").alias("normalized_name"),
        F.col("word").alias("slug"),
        F.concat(F.lit("about "), F.col("word")).alias("description"),
        F.when(F.col("id") % 2 == 0, "active").otherwise("disabled").alias("status"),
        start.alias("created_at"),
        start.alias("updated_at"),
    )


@stored
def links(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of the latest verdict of every article, disabled ones included."""
    newest = evaluations(spark, sf).groupBy("article_id").agg(
        F.max_by(F.struct("id", "tags", "evaluated_at"), "id").alias("e")
    )
    words = newest.select(
        "article_id", F.col("e.id").alias("evaluation_id"), F.col("e.evaluated_at").alias("created_at"),
        F.explode(F.array_distinct(F.transform("e.tags", F.lower))).alias("word"),
    )
    names = vocabulary(spark, sf).select(F.col("id").alias("tag_id"), F.col("normalized_name").alias("word"))
    return words.join(names, "word").select("article_id", "tag_id", "evaluation_id", "created_at")


def tag_candidates(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.col("suggested_tags")[1]
    return evaluations(spark, sf).select(
        "id",
        "article_id",
        F.col("id").alias("evaluation_id"),
        brand.alias("suggested_tag"),
        F.lower(brand).alias("normalized_name"),
        pick(["pending", "approved", "rejected", "pending"], F.col("id") % 4).alias("status"),
        F.lit("seen in a verdict").alias("reason"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.col("evaluated_at").alias("created_at"),
        F.col("evaluated_at").alias("updated_at"),
    )


def stage_history(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.when(F.col("event_type").isin("signup", "purchase"), "evaluate").otherwise("fetch")
    none = F.lit(None).cast("timestamp")
    return read(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("article_id"),
        stage.alias("stage"),
        pick(STATUSES, F.col("event_id") % 5).alias("status"),
        F.lit(None).cast("string").alias("job_id"),
        none.alias("range_since"),
        none.alias("range_until"),
        F.when(F.col("event_id") % 5 == 3, F.col("props")).alias("error"),
        ts("ts").alias("created_at"),
    )


def job_runs(spark: SparkSession, sf: str) -> DataFrame:
    status = pick(["queued", "running", "succeeded", "failed", "skipped"], F.col("event_id") % 5)
    started = ts("ts") + F.make_dt_interval(secs=F.lit(1))
    took = F.make_dt_interval(secs=(F.col("event_id") % 100).cast("int"))
    return read(spark, sf, "events").select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        F.col("event_type").alias("kind"),
        status.alias("status"),
        F.when(F.col("user_id") % 10 < 7, F.concat(F.lit("schedule-"), (F.col("user_id") % 7).cast("string"))).alias(
            "schedule_id"
        ),
        ts("ts").alias("created_at"),
        F.when(F.col("event_id") % 5 != 0, started).alias("started_at"),
        F.when((F.col("event_id") % 5).isin(2, 3), started + took).alias("finished_at"),
        F.col("props").alias("result_json"),
    )


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """A registry with one source per supplier, some of them invalid."""
    k = F.col("s_suppkey")
    host = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.com/"))
    none = F.lit(None).cast("string")
    feed = F.struct(
        pick(["direct", "rsshub", "sitemap", "listing", "gopher"], k % 5).alias("type"),
        F.when(k % 11 == 0, none).when(k % 13 == 0, F.concat(F.lit("ftp://s"), k.cast("string")))
        .otherwise(F.concat(host, F.lit("feed"))).alias("url"),
        F.when(k % 17 == 0, F.lit("//route")).when(k % 19 != 0, F.concat(F.lit("/r/"), k.cast("string"))).alias("route"),
        F.when(k % 3 == 0, F.lit("https://hub.example.org//")).alias("instance"),
        F.create_map(
            F.lit("q"), F.concat(F.col("n_name"), F.lit(" ~*&")), F.lit("full text"), F.lit("True")
        ).alias("params"),
        F.when(k % 4 == 0, F.lit(" ")).otherwise(F.lit("a")).alias("link_selector"),
        none.alias("title_selector"),
        F.array(F.lit("/a")).alias("url_patterns"),
        F.when(k % 23 == 0, F.lit("nowhere")).alias("base_url"),
    )
    manual = F.transform(
        F.sequence(F.lit(1), (k % 3 + 1).cast("int")),
        lambda i: F.struct(
            F.concat(host, F.lit("m"), i.cast("string")).alias("url"),
            F.when(i % 2 == 0, F.concat(F.lit("Manual "), i.cast("string"))).alias("title"),
            F.when(i % 2 == 0, F.lit("2024-02-03")).alias("published_at"),
            F.array(F.lit("hand")).alias("tags"),
        ),
    )
    supplier, nation = read(spark, sf, "supplier"), read(spark, sf, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        k.cast("int").alias("position"),
        F.col("s_name").alias("name"),
        (k % 6 != 0).alias("enabled"),
        pick(["default", "compact", "featured", "huge"], k % 4).alias("display"),
        F.when(k % 7 != 0, feed).alias("feed"),
        F.concat(host, F.lit("blog/")).alias("site_url"),
        F.array(F.lower("n_name")).alias("tags"),
        manual.alias("manual_urls"),
    )


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    """A discovery batch from pages: every page three times, in varying spelling.

    The second sighting has the time, the third the content; all pages of one in
    three ids share a title, so slugs collide.
    """
    pages = read(spark, sf, "pages").select("page_id", "url", F.length("html").alias("size"))
    seen = pages.select("page_id", "url", "size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    p, n = F.col("page_id"), F.col("n")
    title = F.when(p % 3 == 0, F.lit("Weekly notes")).otherwise(F.concat(F.lit("Page "), p.cast("string")))
    host = r"^(https?)://([^/]+)"
    spelled = F.when(n == 1, F.regexp_replace("url", "^http", "HTTP")).when(
        (n == 2) & F.col("url").startswith("https"), F.regexp_replace("url", host, "$1://$2:443")
    ).when(n == 2, F.regexp_replace("url", host, "$1://$2:80")).otherwise(F.col("url"))
    return seen.select(
        F.when(p % 3 == 0, F.lit("src0")).otherwise(F.concat(F.lit("src"), (p % 5).cast("string"))).alias("source_name"),
        (p * 3 + n).alias("ordinal"),
        title.alias("title"),
        spelled.alias("url"),
        F.when(n == 1, F.lit("2024-03-01").cast("timestamp") + days((p % 60).cast("int"))).alias("published_at"),
        F.array(F.concat(F.lit("t"), n.cast("string"))).alias("source_tags"),
        F.when(n == 2, F.concat(F.lit(" size "), F.col("size").cast("string"))).alias("source_content"),
        F.create_map(F.lit("n"), n.cast("string")).alias("source_content_metadata"),
    )


def known_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of an earlier discovery: every fourth page."""
    p = F.col("page_id")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return read(spark, sf, "pages").filter(p % 4 == 0).select(
        p.alias("id"),
        F.lit("old").alias("source_name"),
        F.lit("Old title").alias("title"),
        "url",
        F.col("url").alias("normalized_url"),
        F.when(p == 0, F.lit("src1-page-1")).otherwise(F.concat(F.lit("old-"), p.cast("string"))).alias("slug"),
        F.when(p % 8 == 0, "candidate").otherwise("accepted").alias("status"),
        F.lit(0).alias("retry_count"),
        F.when(p % 3 == 0, at).alias("published_at"),
        F.lit(None).cast("timestamp").alias("collected_at"),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.lit(None).cast("string").alias("error"),
        F.array(F.lit("old")).alias("source_tags"),
        F.when(p % 5 == 0, F.lit("old text")).alias("source_content"),
        F.lit(None).cast("map<string,string>").alias("source_content_metadata"),
    )
