from helpers import article, articles, entries, frame, moment, shown
from pyspark.sql import functions as F

from gleaner import catalog
from gleaner.catalog import stream_queries
from gleaner.functions.times import build_time_range
from gleaner.operators import filters, folds, upsert
from gleaner.streaming import buckets, incremental

EVENTS = "kind string, id bigint, article_id bigint, at timestamp, status string, error string, decision string, published_at timestamp"


def stream_of(spark, folder, *batches):
    """Each frame becomes one file, so one micro-batch, in order."""
    for number, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/input")
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/input")


def test_streamed_upsert_equals_batch(spark, tmp_path):
    folder = str(tmp_path)
    rows = [dict(title=f"t{i}", url=f"https://e.com/{i % 7}", published_at="2026-01-02T00:00:00" if i % 3 == 1 else None,
                 source_content=f"c{i}" if i % 4 == 3 else None) for i in range(21)]
    rows.append(dict(title="late", url="https://e.com/old", published_at="2020-01-01T00:00:00"))
    rows.append(dict(rows[0]))
    whole = entries(spark, *rows).withColumn("seen_at", moment())
    parts = [whole.filter(f"ordinal div 8 = {n}") for n in range(3)]
    since, until = build_time_range("2026-01-01")
    start = articles(spark, article(3), article(99))
    incremental.start_snapshots(start, folder)
    incremental.run_to_end(incremental.upsert_stream(stream_of(spark, folder, *parts), folder, since, until, dedup_within="1 hour"))
    streamed = incremental.latest_snapshot(spark, folder)
    inside = filters.with_window_flag(whole, since, until).filter("NOT out_of_range")
    batch = upsert.upsert_candidates(start, inside, moment())
    pick = lambda frame: sorted((r.normalized_url, r.title, r.status, shown(r.published_at), r.source_content or "") for r in frame.collect())
    assert pick(streamed) == pick(batch)
    assert len(pick(streamed)) == 8


def test_streamed_fold_and_replay(spark, tmp_path):
    folder = str(tmp_path)
    incremental.start_snapshots(articles(spark, article(1), article(2)), folder)
    first = frame(spark, EVENTS, dict(kind="fetch", id=1, article_id=1, at="2026-02-01T00:00:00", status="failed", error="e"),
                  dict(kind="fetch", id=2, article_id=2, at="2026-02-01T00:00:00", status="success"))
    second = frame(spark, EVENTS, dict(kind="fetch", id=3, article_id=1, at="2026-02-02T00:00:00", status="failed", error="f"),
                   dict(kind="evaluation", id=1, article_id=2, at="2026-02-03T00:00:00", decision="accept"))
    writer = incremental.fold_log_stream(stream_of(spark, folder, first, second), folder)
    incremental.run_to_end(writer)
    look = lambda: {r.id: (r.status, r.retry_count, r.error) for r in incremental.latest_snapshot(spark, folder).collect()}
    assert look() == {1: ("candidate", 2, "f"), 2: ("accepted", 0, None)}
    # Nothing new: no batch, same state.
    incremental.run_to_end(incremental.fold_log_stream(stream_of(spark, folder, first.limit(0)), folder))
    assert look() == {1: ("candidate", 2, "f"), 2: ("accepted", 0, None)}


def test_streamed_discovery_counts_against_earlier_batches(spark, tmp_path):
    folder = str(tmp_path)
    page = lambda i, at=None: dict(title=f"t{i}", url=f"https://e.com/{i}", published_at=at)
    rows = [page(1), page(5), page(5), page(6), page(7, "2020-01-01T00:00:00"), page(5), page(7), page(2)]
    whole = entries(spark, *rows).withColumn("seen_at", moment())
    since, until = build_time_range("2026-01-01")
    known = articles(spark, article(1, status="accepted"), article(2))
    ddl = "article_id bigint, stage string, status string"
    logs = frame(spark, "article_id bigint, status string", dict(article_id=2, status="success")), frame(
        spark, ddl, dict(article_id=4, stage="fetch", status="running"))
    states = frame(spark, "last_status string", *[dict(last_status=s) for s in ("failed", "not_modified", "failed", "success")])
    incremental.start_snapshots(known, folder)
    stream = stream_of(spark, folder, whole.filter("ordinal < 5"), whole.filter("ordinal >= 5"))
    incremental.run_to_end(incremental.discovery_stream(stream, folder, since, until, *logs, states))
    got = [tuple(r)[:7] for r in spark.read.parquet(f"{folder}/counters").orderBy("batch").collect()]
    # 5 gets id 3 and stays queued; 6 gets id 4; 7 is outside at first
    assert got == [(5, 2, 2, 3, 1, 2, 1), (3, 1, 2, 2, 0, 2, 1)]
    ids = {r.normalized_url[-1]: r.id for r in incremental.latest_snapshot(spark, folder).collect()}
    assert ids == {"1": 1, "2": 2, "5": 3, "6": 4, "7": 5}


def test_late_rows_are_dropped(spark, tmp_path):
    # Spark judges lateness by the watermark that held before the previous
    # micro-batch, so the late row comes two batches after the one that passed it.
    folder = str(tmp_path)
    schema = "created_at timestamp, stage string, status string"
    row = lambda t: dict(created_at=f"2026-01-01T{t}", stage="fetch", status="failed")
    stream = stream_of(spark, folder, frame(spark, schema, row("00:10:00"), row("00:20:00"), row("03:00:00")),
                       frame(spark, schema, row("03:10:00")), frame(spark, schema, row("00:30:00"), row("06:00:00")),
                       frame(spark, schema, row("06:10:00")))
    incremental.run_to_end(
        incremental.stage_counts(stream).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/counts"))
    got = {shown(r.window_start): r.n for r in spark.read.parquet(f"{folder}/counts").collect()}
    assert got == {"2026-01-01T00:00:00": 2, "2026-01-01T03:00:00": 2}


def test_streamed_stage_counts_write_with_many_tasks(spark, tmp_path, monkeypatch):
    schema = "created_at timestamp, stage string, status string"
    rows = [dict(created_at=f"2026-01-01T{i // 60:02}:{i % 60:02}:00", stage="fetch", status="failed") for i in range(600)]
    history = frame(spark, schema, *rows).repartition(6)
    monkeypatch.setattr(stream_queries.t, "stage_history", lambda spark, sf: history)
    monkeypatch.setattr(stream_queries, "shared_folder", lambda spark, purpose: str(tmp_path))
    got = catalog.queries()["streamed_stage_counts"](spark, "").collect()
    assert len(list(tmp_path.glob("input/part-*"))) == 12
    assert sorted(r.n for r in got) == [60] * 9


def test_late_log_rows_do_not_win(spark):
    log = [("evaluation", 1, "2026-02-02T00:00:00", None, "accept", None), ("evaluation", 2, "2026-01-01T00:00:00", None, "reject", None),
           ("fetch", 3, "2026-02-03T00:00:00", "success", None, "2026-01-05T00:00:00"), ("fetch", 4, "2026-01-02T00:00:00", "failed", None, None),
           ("fetch", 5, "2026-01-03T00:00:00", "success", None, "2025-12-01T00:00:00")]
    rows = [dict(kind=k, id=i, article_id=1, at=at, status=s, error="late" if s == "failed" else None, decision=d, published_at=p) for k, i, at, s, d, p in log]
    ddl = "kind string, id bigint, article_id bigint, at timestamp, status string, error string, decision string, published_at timestamp"

    def parts(batch):
        fetched = batch.filter("kind = 'fetch'").select("id", "article_id", F.col("at").alias("fetched_at"), "status", "error", "published_at")
        judged = batch.filter("kind = 'evaluation'").select("id", "article_id", F.col("at").alias("evaluated_at"), "decision")
        return fetched, judged

    start = folds.with_marks(articles(spark, article(1), article(2, published_at="2025-01-01T00:00:00")))
    whole = [tuple(r) for r in folds.fold_state(start, *parts(frame(spark, ddl, *rows))).drop("marks").orderBy("id").collect()]
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 0, 4, 1, 3]):
        state = start
        for i in order:
            state = folds.fold_state(state, *parts(frame(spark, ddl, rows[i])))
        assert [tuple(r) for r in state.drop("marks").orderBy("id").collect()] == whole
    row = folds.fold_state(start, *parts(frame(spark, ddl, *rows))).filter("id = 1").first()
    assert (row.status, row.retry_count, row.error) == ("accepted", 1, None) and row.published_at.year == 2025


def test_small_batches_leave_most_files(spark, tmp_path):
    n, folder = 20_000, str(tmp_path)
    state = buckets.Buckets.create(spark.range(n).withColumn("v", F.lit(0)), folder, "id", 40, top=7)
    files = lambda one: {(bucket, batch) for bucket, layers in one.parts.items() for batch, _ in layers}
    want = {i: 0 for i in range(n)}
    for number in range(1, 12):
        keys = spark.range(number * 3, n + 5, n // 100).select(F.col("id").cast("long").alias("id"))
        touched = state.touched(keys)
        before = state.before(keys, touched)
        after = before.withColumn("v", F.when(F.col("id") % (n // 100) == number * 3, F.lit(number)).otherwise(F.col("v")))
        new = state.advanced(after, touched)
        # a replay gives the same
        assert state.advanced(after, touched).parts == new.parts
        kept = files(state) & files(new)
        if number < buckets.MOST_LAYERS:
            assert kept == files(state)
        new.forget_before()
        want |= {i: number for i in range(number * 3, n, n // 100)}
        state = new
        assert buckets.Buckets.latest(spark, folder).version == number and state.facts == {"top": 7}
    assert {r.id: r.v for r in state.rows().collect()} == want
    assert all(len(layers) <= buckets.MOST_LAYERS + 1 for layers in state.parts.values())
    used = {batch for _, batch in files(state)} | {batch for _, batch in files(buckets.Buckets.load(spark, folder, 10))}
    assert {int(path.name.partition("=")[2]) for path in tmp_path.glob("rows/batch=*")} == used
    # a batch of most rows writes its buckets anew, in one layer
    whole = state.rows().select("id")
    touched = state.touched(whole)
    full = state.advanced(state.before(whole, touched), touched)
    assert all(len(layers) == 1 for layers in full.parts.values()) and full.rows().count() == n


def test_new_keys_and_empty_buckets(spark, tmp_path):
    state = buckets.Buckets.create(spark.createDataFrame([(1, "a")], "id bigint, v string"), str(tmp_path), "id", 16)
    more = spark.createDataFrame([(i, "b") for i in range(2, 30)], "id bigint, v string")
    touched = state.touched(more)
    state = state.advanced(state.before(more, touched).unionByName(more), touched)
    assert sorted((r.id, r.v) for r in state.rows().collect()) == [(1, "a"), *[(i, "b") for i in range(2, 30)]]
    assert state.advanced(more.limit(0), {}).rows().count() == 29
    nothing = buckets.Buckets.create(more.limit(0), str(tmp_path / "empty"), "id", 4)
    assert nothing.rows().count() == 0 and buckets.buckets_for(0) == 8 and buckets.buckets_for(10**12) == buckets.MOST_BUCKETS


def test_latencies_and_what_has_none(spark, tmp_path):
    folder, kind = str(tmp_path), "id bigint, article_id bigint, stage string, at timestamp"
    row = lambda i, article, stage, at: dict(id=i, article_id=article, stage=stage, at=f"2026-01-0{at}")
    first = [row(1, 1, "fetch", "1T00:00:00"), row(2, 2, "fetch", "1T00:10:00"), row(3, 1, "evaluate", "1T00:30:00"), row(4, 3, "fetch", "1T00:40:00")]
    second = [row(5, 1, "evaluate", "1T01:00:00"), row(6, 3, "evaluate", "1T01:30:00"), row(7, 2, "evaluate", "1T02:00:00"), row(8, 4, "fetch", "2T00:00:00"),
              row(9, 9, "evaluate", "2T00:00:00")]
    # long behind the watermark
    third = [row(10, 5, "fetch", "1T00:05:00"), row(11, 4, "evaluate", "2T00:20:00"), row(12, 6, "fetch", "3T00:00:00"), row(13, 9, "evaluate", "3T00:00:00")]
    last = [row(14, 9, "fetch", "4T00:00:00"), row(15, 9, "evaluate", "4T02:00:00")]
    stream = stream_of(spark, folder, *[frame(spark, kind, *rows) for rows in (first, second, third, last)])
    sides = [stream.filter(F.col("stage") == stage).withColumnRenamed("at", at).drop("stage") for stage, at in (("fetch", "fetched_at"), ("evaluate", "evaluated_at"))]
    incremental.run_to_end(incremental.latency_stream(incremental.stage_latencies(*sides, within="1 hour"), folder))
    found = spark.read.parquet(f"{folder}/latencies").collect()
    assert sorted((r.fetch_id, r.evaluation_id, r.micros // 60_000_000) for r in found) == [(1, 3, 30), (1, 5, 60), (4, 6, 50), (8, 11, 20)]
    assert {r.fetch_id for r in spark.read.parquet(f"{folder}/unmatched").collect()} == {2, 12}
    fetched = frame(spark, kind, *first, *second, *third, *last).filter("stage = 'fetch'").withColumnRenamed("at", "fetched_at")
    late = incremental.late_rows(fetched, spark, folder, F.lit("2026-01-03").cast("timestamp"))
    assert [r.id for r in late.collect()] == [10]
