import datetime
import random
from collections import Counter

import pytest
from helpers import article, articles, entries, evaluations, failures, fetches, frame, moment, shown
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions.times import build_time_range
from gleaner.operators import content, filters, folds, history, latest, pending, upsert


def test_upsert_merges_spellings_of_one_address(spark):
    batch = entries(
        spark,
        dict(title="A", url="HTTPS://Example.com:443/post", source_tags=["x"]),
        dict(title="B", url="https://example.com/post", published_at="2026-01-02T00:00:00", source_content="  "),
        dict(title="C", url="https://example.com/post", published_at="2026-01-03T00:00:00", source_content=" text ",
             source_content_metadata={"k": "v"}),
        dict(title="D", url="https://example.com/post?x=1"),
        dict(title="E", url="https://example.com/post/"),
        dict(title="", url="https://example.com/post#f"),
    )
    got = {r.normalized_url: r for r in upsert.upsert_candidates(articles(spark), batch, moment()).collect()}
    assert len(got) == 4
    first = got["https://example.com/post"]
    assert (first.title, first.url, first.source_tags, first.status, first.retry_count) == (
        "A", "HTTPS://Example.com:443/post", ["x"], "candidate", 0)
    assert (shown(first.published_at), first.source_content, first.source_content_metadata) == (
        "2026-01-02T00:00:00", "text", {"k": "v"})
    assert got["https://example.com/post#f"].title == "https://example.com/post#f"


def test_upsert_only_fills_gaps_and_is_idempotent(spark):
    before = articles(
        spark,
        article(1, published_at="2025-01-01T00:00:00", source_content="own"),
        article(2, status="accepted"),
        article(3),
    )
    batch = entries(
        spark,
        dict(title="N", url="https://e.com/1", published_at="2026-01-02T00:00:00", source_content="new"),
        dict(title="N", url="https://e.com/2", published_at="2026-01-02T00:00:00", source_content="new"),
        dict(title="N", url="https://e.com/9"),
    )
    once = upsert.upsert_candidates(before, batch, moment())
    got = {r.normalized_url: r for r in once.collect()}
    assert (got["https://e.com/1"].source_content, shown(got["https://e.com/1"].updated_at)) == ("own", "2026-01-01T00:00:00")
    two = got["https://e.com/2"]
    assert (two.title, two.status, two.source_content, shown(two.published_at), shown(two.updated_at)) == (
        "T2", "accepted", "new", "2026-01-02T00:00:00", "2026-03-01T00:00:00")
    assert got["https://e.com/9"].id > 3
    again = upsert.upsert_candidates(once, batch, moment("2026-04-01T00:00:00"))
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_slugs_stay_unique_under_a_hot_title(spark):
    rows = [dict(title="Weekly notes", url=f"https://e.com/w{i}") for i in range(60)] + [
        dict(title="Taken", url="https://e.com/x"), dict(title="Other", url="https://e.com/y")]
    before = articles(spark, article(1, slug="s-taken"))
    got = [r for r in upsert.upsert_candidates(before, entries(spark, *rows), moment()).collect() if r.id != 1]
    assert len({r.slug for r in got}) == len(got) == 62
    by_url = {r.url: r.slug for r in got}
    assert by_url["https://e.com/w0"] == "s-weekly-notes"
    assert by_url["https://e.com/w1"].startswith("s-weekly-notes-")
    assert by_url["https://e.com/x"].startswith("s-taken-") and by_url["https://e.com/y"] == "s-other"


def sequential(before, rows):
    """Row-at-a-time upsert, to check the set-based one against."""
    known = {u: dict(v) for u, v in before.items()}
    for row in rows:
        hit = known.get(row["url"])
        text = (row.get("source_content") or "").strip() or None
        if hit is None:
            known[row["url"]] = dict(title=row["title"], published_at=row.get("published_at"), source_content=text)
        else:
            hit["published_at"] = hit["published_at"] or row.get("published_at")
            hit["source_content"] = hit["source_content"] or text
    return known


def test_upsert_equals_row_at_a_time(spark):
    import random

    rng = random.Random(7)
    rows = []
    for i in range(400):
        # One address holds a third of the batch.
        key = 0 if rng.random() < 0.33 else rng.randrange(40)
        rows.append(dict(title=f"t{i}", url=f"https://e.com/{key}",
                         published_at=rng.choice([None, "2026-01-0%dT00:00:00" % rng.randrange(1, 9)]),
                         source_content=rng.choice([None, " ", f"text {i}"])))
    before = {f"https://e.com/{k}": dict(title=f"T{k}", published_at=None, source_content=None) for k in range(10)}
    start = articles(spark, *[article(k) for k in range(10)])
    got = upsert.upsert_candidates(start, entries(spark, *rows), moment()).collect()
    want = sequential(before, rows)
    assert {r.normalized_url: (r.title, shown(r.published_at), r.source_content) for r in got} == {
        u: (v["title"], v["published_at"], v["source_content"]) for u, v in want.items()}
    assert len(got) == len(want)


def test_duplicate_repair(spark):
    rows = articles(spark, *[article(i, normalized_url="https://e.com/a" if i != 3 else "https://e.com/b") for i in (1, 2, 3, 4)])
    got = {r.id: r.normalized_url for r in upsert.repair_duplicates(rows).collect()}
    assert got == {1: "https://e.com/a", 2: "https://e.com/a#duplicate-2", 3: "https://e.com/b", 4: "https://e.com/a#duplicate-4"}


def test_fold_of_fetches_evaluations_and_overrides(spark):
    start = articles(spark, article(1, error="old"), article(2, published_at="2025-01-01T00:00:00"), article(3), article(4),
                     article(5, status="accepted", collected_at="2026-01-05T00:00:00", error="old"))
    fetched = fetches(
        spark,
        dict(id=1, article_id=1, status="failed", error="e1", fetched_at="2026-02-01T00:00:00"),
        dict(id=2, article_id=1, status="failed", error="e2", fetched_at="2026-02-02T00:00:00"),
        dict(id=3, article_id=2, content="c", published_at="2026-01-01T00:00:00"),
        dict(id=4, article_id=3, content="c", published_at="2026-01-07T00:00:00"),
        dict(id=5, article_id=3, content="c", published_at="2026-01-09T00:00:00"),
    )
    judged = evaluations(
        spark,
        dict(id=1, article_id=3, decision="accept", evaluated_at="2026-02-05T00:00:00"),
        dict(id=2, article_id=3, decision="reject", evaluated_at="2026-02-06T00:00:00"),
        dict(id=3, article_id=4, decision="unsure", evaluated_at="2026-02-06T00:00:00"),
    )
    override = frame(spark, "id bigint, article_id bigint, status string, changed_at timestamp",
                     dict(id=1, article_id=5, status="rejected", changed_at="2026-02-07T00:00:00"))
    skips = frame(spark, "id bigint, article_id bigint, skipped_at timestamp", dict(id=1, article_id=2, skipped_at="2026-02-01T00:00:00"))
    got = {r.id: r for r in folds.fold_state(start, fetched, judged, override, skips).collect()}
    assert (got[1].retry_count, got[1].error, got[1].status, shown(got[1].updated_at)) == (2, "e2", "candidate", "2026-02-02T00:00:00")
    assert (got[2].status, got[2].error, shown(got[2].published_at)) == (
        "skipped_out_of_range", "published_at is outside requested range", "2025-01-01T00:00:00")
    assert (got[3].status, shown(got[3].collected_at), shown(got[3].published_at)) == ("rejected", "2026-02-05T00:00:00", "2026-01-07T00:00:00")
    assert got[4].status == "low_confidence" and got[4].collected_at is None
    assert (got[5].status, got[5].error, shown(got[5].collected_at)) == ("rejected", "old", "2026-01-05T00:00:00")


def test_failed_evaluations_change_nothing(spark):
    start = articles(spark, article(1))
    folded = folds.fold_state(start, fetches(spark), evaluations(spark))
    assert folded.collect() == start.collect()
    due = pending.ready_for_evaluation(start, fetches(spark, dict(id=1, article_id=1, content="c")), evaluations(spark))
    assert [r.id for r in due.collect()] == [1]


def test_latest_under_a_hot_key(spark):
    rows = [dict(id=i, article_id=1 if i % 3 == 0 else i, status="failed" if i % 2 else "success", content=f"c{i}") for i in range(300)]
    log = fetches(spark, *rows)
    want = {}
    for row in rows:
        want[row["article_id"]] = max(want.get(row["article_id"], -1), row["id"])
    assert {r.article_id: r.id for r in latest.latest_fetch(log).collect()} == want
    assert {r.article_id: r.id for r in latest.latest_rows(log, "article_id").collect()} == want
    assert Counter(r.article_id for r in latest.last_n(log, "article_id", 4).collect())[1] == 4


def test_pending_sets(spark):
    rows = articles(spark, article(1), article(2, retry_count=3), article(3), article(4, status="accepted"), article(5))
    log = fetches(spark, dict(id=1, article_id=3), dict(id=2, article_id=1, status="failed"), dict(id=3, article_id=5))
    judged = evaluations(spark, dict(id=1, article_id=5))
    assert [r.id for r in pending.ready_for_fetch(rows, log).orderBy("id").collect()] == [1]
    assert [r.id for r in pending.ready_for_evaluation(rows, log, judged).orderBy("id").collect()] == [3]
    history = frame(spark, schemas.STAGE_HISTORY, dict(id=1, article_id=1, stage="fetch", status="queued"),
                    dict(id=2, article_id=3, stage="fetch", status="succeeded"))
    asked = frame(spark, "article_id bigint, stage string, range_since timestamp, range_until timestamp, ordinal bigint",
                  dict(article_id=1, stage="fetch", ordinal=1), dict(article_id=3, stage="fetch", ordinal=2, range_since="2026-01-01T00:00:00"),
                  dict(article_id=3, stage="fetch", ordinal=3), dict(article_id=1, stage="evaluate", ordinal=4))
    got = pending.enqueue(asked, history).orderBy("ordinal").collect()
    assert [(r.article_id, r.stage, r.ordinal, shown(r.range_since)) for r in got] == [
        (3, "fetch", 2, "2026-01-01T00:00:00"), (1, "evaluate", 4, None)]
    assert [r.queue_id for r in pending.queued_items(history, rows, "fetch").collect()] == [1]
    assert [r.id for r in pending.by_ids(rows, [5, 1]).collect()] == [1, 5]
    assert pending.lookup(rows, "slug", "s-t3").first().id == 3


def test_window_null_rules_differ(spark):
    rows = articles(spark, article(1), article(2, published_at="2026-05-01T00:00:00"), article(3, published_at="2026-06-01T00:00:00"))
    since, until = build_time_range("2026-05-01", "2026-05-31")
    flagged = filters.with_window_flag(rows, since, until)
    assert {r.id: r.out_of_range for r in flagged.collect()} == {1: False, 2: False, 3: True}
    assert [r.id for r in filters.published_between(rows, "2026-05-01", "2026-05-31").collect()] == [2]
    assert filters.published_between(rows, "whenever", None).count() == 3


def test_content_choice(spark):
    rows = articles(
        spark,
        article(1, source_content="feed text"), article(2, source_content="x" * 20), article(3), article(4), article(5),
        article(6, source_content="é" * 6),
    )
    pages = frame(
        spark, "url string, content string, published_at timestamp, fetch_error string",
        dict(url="https://e.com/1", content="page 1"), dict(url="https://e.com/2", content=" page 2 "),
        dict(url="https://e.com/3", content="  "), dict(url="https://e.com/4", content="y" * 11), dict(url="https://e.com/5", fetch_error="timeout"),
        dict(url="https://e.com/6", content="short"),
    )
    got = {r.article_id: r for r in content.choose_content(rows, pages, max_bytes=10).collect()}
    assert {k: (r.status, r.content, r.error) for k, r in got.items()} == {
        1: ("success", "feed text", None), 2: ("success", "page 2", None), 3: ("failed", None, "empty markdown"),
        4: ("failed", None, "markdown too large: 11 > 10"), 5: ("failed", None, "timeout"), 6: ("success", "short", None)}
    assert got[1].metadata["crawler"] == "feed-entry"


def test_window_recheck_after_fetch(spark):
    rows = articles(spark, article(1), article(2), article(3, published_at="2026-05-01T00:00:00"))
    outcomes = fetches(spark, dict(article_id=1, published_at="2025-06-01T00:00:00"), dict(article_id=2),
                       dict(article_id=3, published_at="2025-06-01T00:00:00")).drop("id", "fetched_at")
    since, until = build_time_range("2026-01-01", "2026-12-31")
    checked = content.recheck_window(outcomes, rows, since, until)
    assert {r.article_id: (r.stage_status, r.next_stage) for r in checked.collect()} == {
        1: ("skipped_out_of_range", None), 2: ("succeeded", "evaluate"), 3: ("succeeded", "evaluate")}
    counted = content.fetch_counters(checked).first()
    assert (counted.attempted, counted.succeeded, counted.failed, counted.skipped, counted.queued_evaluate) == (3, 2, 0, 1, 2)


def test_failed_only(spark):
    rows = articles(spark, *[article(i) for i in range(1, 6)])
    log = fetches(spark, dict(id=1, article_id=1, status="failed"), dict(id=2, article_id=1), dict(id=3, article_id=2),
                  dict(id=4, article_id=2, status="failed"))
    judged, failed = evaluations(spark, dict(id=1, article_id=3)), failures(spark, dict(id=1, article_id=3), dict(id=2, article_id=4), dict(id=3, article_id=4))
    assert sorted(r.id for r in filters.failed_only(rows, log, judged, failed).collect()) == [2, 4]


def test_discovery_counters(spark):
    batch = entries(
        spark, dict(title="a", url="https://e.com/1"), dict(title="b", url="https://e.com/1"), dict(title="c", url="https://e.com/7"),
        dict(title="d", url="https://e.com/8", published_at="2020-01-01T00:00:00"), dict(title="e", url="https://e.com/2"),
    )
    since, until = build_time_range("2026-01-01")
    known = articles(spark, article(1), article(2, status="accepted"))
    history = frame(spark, schemas.STAGE_HISTORY)
    got = upsert.discovery_counters(filters.with_window_flag(batch, since, until), known, fetches(spark), history).first()
    assert got.asDict() == dict(found=5, inserted=1, queued_fetch=2, skipped=4, out_of_range=1)
    empty = upsert.discovery_counters(filters.with_window_flag(entries(spark), since, until), known, fetches(spark), history).first()
    assert empty.asDict() == dict(found=0, inserted=0, queued_fetch=0, skipped=0, out_of_range=0)


def _log(draw, n, keys=4, days=30):
    return [(i, draw.randrange(keys), None if draw.random() < 0.03 else day(draw.randrange(days)), draw.choice(["success", "failed"])) for i in range(1, n + 1)]


def day(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)


def brute_as_of(rows, moment):
    """The largest id of every key among the rows known at a moment."""
    found = {}
    for i, key, at, status in rows:
        if at is not None and at <= moment:
            found[key] = (i, status)
    return found


@pytest.mark.parametrize("bits", [16, 2])
def test_state_of_every_past_day(spark, monkeypatch, bits):
    monkeypatch.setattr(history, "_BUCKET_BITS", bits)
    rows = _log(random.Random(bits), 80)
    log = spark.createDataFrame(rows, "id bigint, article_id bigint, at timestamp, status string")
    spans = history.intervals(log, "article_id", "at", "status").cache()
    for n in range(-1, 31):
        got = {r.article_id: (r.id, r.status) for r in history.as_of(spans, F.lit(day(n))).collect()}
        assert got == brute_as_of(rows, day(n)), n
    moments = [F.lit(day(n)) for n in range(0, 30, 7)]
    for r in history.at_moments(spans, moments).groupBy("moment").agg(F.map_from_entries(F.collect_list(F.struct("article_id", "id"))).alias("ids")).collect():
        assert r.ids == {key: i for key, (i, _) in brute_as_of(rows, r.moment).items()}
    asked = _log(random.Random(9), 50, keys=5, days=40)
    frame_of = spark.createDataFrame([(i, key, at) for i, key, at, _ in asked], "ask bigint, article_id bigint, moment timestamp")
    got = {r["ask"]: r.id for r in history.joined_as_of(frame_of, spans, "article_id", "moment", "week").collect()}
    want = {i: brute_as_of(rows, at).get(key, (None,))[0] for i, key, at, _ in asked if at is not None}
    assert got == {i: found for i, found in want.items() if found is not None}
    spans.unpersist()
    assert history.intervals(log.limit(0), "article_id", "at").count() == 0
