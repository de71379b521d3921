import json
import random
import re

import pytest
from helpers import article, articles, evaluations, failures, fetches, frame, plan_of, shown, vocabulary
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions.times import item_time
from gleaner.operators import filters, membership, page_dates
from gleaner.plans import listings, paging, publishing, reports, search


def state(spark):
    rows = articles(
        spark,
        article(1, title="Queue latency", status="accepted", published_at="2026-01-01T00:00:00", updated_at="2026-01-05T00:00:00"),
        article(2, title='Say "hi"', status="accepted", source_name="other", collected_at="2026-01-03T00:00:00"),
        article(3, title="No verdict", status="accepted", updated_at="2026-01-09T00:00:00"),
        article(4, title="Pending"),
        article(5, title="Broken", status="rejected"),
    )
    log = fetches(
        spark, dict(id=1, article_id=1, content=" body "), dict(id=2, article_id=1, status="failed", error="late"),
        dict(id=3, article_id=2, content="b2"), dict(id=4, article_id=3, content="b3"), dict(id=5, article_id=5, status="failed", error="gone"),
    )
    judged = evaluations(spark, dict(id=1, article_id=1, summary="old"), dict(id=2, article_id=1, summary="new"), dict(id=3, article_id=2, summary=" "))
    failed = failures(spark, dict(id=1, article_id=4, error="e1"), dict(id=2, article_id=4, error="e2"), dict(id=3, article_id=1))
    words = vocabulary(spark, "web", "AI", "-Off")
    tagged = frame(spark, schemas.ARTICLE_TAGS, dict(article_id=1, tag_id=1), dict(article_id=1, tag_id=2), dict(article_id=2, tag_id=3))
    return rows, log, judged, failed, tagged, words


def test_article_page(spark):
    rows, log, judged, failed, *_ = state(spark)
    history = frame(spark, schemas.STAGE_HISTORY, *[dict(id=i, article_id=1, stage=s, status=v) for i, (s, v) in enumerate(
        [("fetch", "queued"), ("fetch", "succeeded"), ("evaluate", "failed")])])
    page = lambda **k: listings.article_page(rows, log, judged, failed, history, **k).collect()
    assert [r.id for r in page()] == [3, 1, 5, 4, 2]
    assert [r.id for r in page(sort="published_at", order="asc")] == [2, 3, 4, 5, 1]
    assert [r.id for r in page(page=2, page_size=2)] == [5, 4]
    (one,) = page(q="QUEUE")
    assert (one.fetch_status, one.fetch_error, one.evaluation_status, one.evaluation_error, one.fetch_queue_status,
            one.evaluate_queue_status) == ("failed", "late", "accept", "bad", "succeeded", "failed")
    assert [r.id for r in page(failed_only=True)] == [1, 5, 4]
    assert [r.id for r in page(status="unaccepted", failed_only=True)] == [5, 4]
    assert listings.page_values(0, 1000) == (1, 1000)


def test_page_envelope(spark):
    rows = state(spark)[0]
    items = listings.paged(rows.orderBy("id").select("id"), 2, 2)
    got = listings.page_envelope(items, rows, 2, 2).first()
    assert ([i.id for i in got["items"]], got.total, got.page, got.page_size, got.has_next) == ([3, 4], 5, 2, 2, True)
    assert not listings.page_envelope(items, rows, 3, 2).first().has_next


def test_summary_and_failures(spark):
    rows, log, judged, failed, *_ = state(spark)
    assert reports.summary(rows, log, judged, failed).first().asDict() == dict(
        total=5, candidate=1, accepted=3, rejected=1, low_confidence=0, skipped_out_of_range=0, fetch_failed=2, evaluation_failed=1)
    assert [(r.article_id, r.stage, r.error) for r in reports.failure_report(rows, log, judged, failed).collect()] == [
        (1, "fetch", "late"), (4, "evaluation", "e2"), (5, "fetch", "gone")]
    assert {r.status: r.n for r in reports.status_counts(rows).collect()} == dict(
        candidate=1, accepted=3, rejected=1, low_confidence=0, skipped_out_of_range=0)
    assert [r.source_name for r in reports.source_names(rows).collect()] == ["other", "s"]


def test_listed_but_not_published(spark):
    rows, log, judged, _, tagged, words = state(spark)
    index = listings.public_index(rows, judged, tagged, words).collect()
    assert [(r.id, r.summary, r.tags) for r in index] == [(3, None, []), (2, " ", []), (1, "new", ["AI", "web"])]
    records = publishing.public_records(publishing.newest_first(publishing.publishable(rows, log, judged, tagged, words)))
    assert records.columns == publishing.RECORD
    assert [r.slug for r in records.collect()] == ["s-t2", "s-t1"]
    detail = {r.slug: r for r in listings.public_detail(rows, log, judged, tagged, words).collect()}
    assert detail["s-t3"].content == "b3" and detail["s-t3"].summary is None
    assert "source_content" not in detail["s-t3"].asDict()
    assert listings.public_detail(rows, log, judged, tagged, words, "s-t4").count() == 0


def test_article_detail(spark):
    rows, log, judged, failed, *_ = state(spark)
    history = frame(spark, schemas.STAGE_HISTORY, *[dict(id=i, article_id=1, stage="fetch", status="queued") for i in range(15)])
    ids = spark.createDataFrame([(1,), (4,)], "id bigint")
    got = {r.article_id: r for r in listings.article_detail(rows, log, judged, failed, history, ids).collect()}
    assert (got[1].latest_fetch.id, got[1].latest_evaluation.summary, [q.id for q in got[1].queue]) == (2, "new", list(range(14, 4, -1)))
    assert (got[4].latest_fetch, got[4].latest_evaluation_failure.error, got[4].queue) == (None, "e2", [])


def test_snapshot_and_stale(spark, tmp_path):
    rows, log, judged, _, tagged, words = state(spark)
    ready = publishing.publishable(rows, log, judged, tagged, words)
    folder = str(tmp_path / "public")
    assert publishing.published_version(spark, folder) is None
    version = publishing.publish_snapshot(ready, folder)
    assert publishing.published_version(spark, folder) == version
    stored = {r.slug: r for r in spark.read.parquet(f"{publishing.published_version(spark, folder)}/articles").collect()}
    record = json.loads(stored["s-t2"].record)
    assert list(record) == publishing.RECORD and record["published_at"] is None and record["tags"] == []
    assert stored["s-t1"].document == (
        '---\ntitle: "Queue latency"\nurl: "https://e.com/1"\nsource: "s"\ncontent_type: "tooling_note"\n'
        'published_at: "2026-01-01T00:00:00Z"\ncollected_at: ""\ntags:\n  - "AI"\n  - "web"\n---\n\n'
        "> 来源信息\n>\n> - 来源：s\n> - 原文：https://e.com/1\n> - 原文时间：2026-01-01T00:00:00Z\n> - 抓取时间：2026-02-01T00:00:00Z\n\nbody\n")
    assert 'title: "Say \\"hi\\""' in stored["s-t2"].document and "原文时间：未知" in stored["s-t2"].document
    lines = [json.loads(line) for part in sorted((tmp_path / "public" / "version-1" / "index").glob("part-*")) for line in part.read_text("utf-8").splitlines()]
    assert [line["slug"] for line in lines] == ["s-t2", "s-t1"]
    demoted = publishing.publishable(rows.filter("id <> 2"), log, judged, tagged, words)
    previous = spark.createDataFrame([(s,) for s in stored], "slug string")
    assert [r.slug for r in publishing.stale_slugs(previous, demoted).collect()] == ["s-t2"]
    for _ in range(2):
        publishing.publish_snapshot(demoted, folder)
    assert sorted(p.name for p in (tmp_path / "public").glob("version-*")) == ["version-2", "version-3"]
    assert [r.slug for r in spark.read.parquet(f"{publishing.published_version(spark, folder)}/articles").collect()] == ["s-t1"]
    assert publishing.publish_counter(demoted).first().published == 1


def test_feed(spark):
    from xml.etree import ElementTree

    rows, _, judged, _, tagged, words = state(spark)
    items = publishing.feed_items(rows, judged, tagged, words, "https://pub.org/")
    feed = publishing.feed_document(items, "T & T", "https://pub.org", "D").first()
    channel = ElementTree.fromstring(feed.document.encode()).find("channel")
    got = channel.findall("item")
    assert [i.findtext("guid") for i in got] == [f"https://pub.org/api/public/articles/s-t{n}" for n in (3, 2, 1)]
    assert [c.text for c in got[2].findall("category")] == ["工具笔记", "AI", "web"]
    assert got[1].findtext("description") == "R\n\n原文：https://e.com/2" and got[1].find("source").get("url") == "https://e.com/2"
    assert feed.last_modified == channel.findtext("lastBuildDate") == "Fri, 09 Jan 2026 00:00:00 GMT"
    frame_of = publishing.feed_document(items, "T & T", "https://pub.org", "D")
    asked = spark.createDataFrame(
        [(1, feed.etag, None), (2, f" {feed.etag} ", None), (3, '"x"', feed.last_modified), (4, None, feed.last_modified),
         (5, None, "Thu, 08 Jan 2026 00:00:00 GMT"), (6, None, "soon"), (7, None, None)],
        "n int, if_none_match string, if_modified_since string")
    assert {r.n: r.unchanged for r in publishing.not_modified(asked, frame_of).collect()} == {
        1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}
    assert publishing.feed_items(rows, judged, tagged, words, "https://pub.org", limit=1).count() == 1
    assert shown(publishing.latest_item_time(items).first().latest) == "2026-01-09T00:00:00"


def test_tag_listing(spark):
    _, _, _, _, tagged, words = state(spark)
    assert [(r.name, r.article_count) for r in listings.tag_page(words, tagged).collect()] == [("AI", 1), ("web", 1), ("Off", 1)]
    assert [r.name for r in listings.tag_page(words, tagged, status="active", q="W").collect()] == ["web"]


ORDERS = [[("a", True), ("id", True)], [("a", False), ("id", False)], [("a", True), ("b", False), ("id", True)]]


@pytest.mark.parametrize("order", ORDERS)
def test_cursor_pages_are_the_offset_pages(spark, order):
    draw = random.Random(7)
    rows = [(i, draw.choice([None, 1, 2, 3]), draw.choice([None, "x", "y"])) for i in range(60)]
    table = spark.createDataFrame(rows, "id bigint, a int, b string")
    whole = [r.id for r in table.orderBy(*paging.ordering(order)).collect()]
    cursor, seen = None, []
    while True:
        page = paging.cursor_page(table, order, 7, cursor)
        envelope = paging.cursor_envelope(page, table, order).first()
        assert envelope.total == 60
        if not envelope["items"]:
            assert envelope.cursor is None and paging.cursor_of(page, order) is None
            break
        seen += [item.id for item in envelope["items"]]
        assert [r.id for r in table.orderBy(*paging.ordering(order)).offset(len(seen) - len(envelope["items"])).limit(7).collect()] == [i.id for i in envelope["items"]]
        cursor = paging.cursor_of(page, order)
        assert cursor == envelope.cursor.asDict()
    assert seen == whole


def test_listings_by_cursor(spark):
    rows, log, judged, failed, tagged, words = state(spark)
    history = frame(spark, schemas.STAGE_HISTORY, dict(id=1, article_id=1, stage="fetch", status="queued"))
    for sort, order in (("updated_at", "desc"), ("published_at", "asc"), ("published_at", "desc")):
        keys = listings.listing_keys(sort, order)
        whole = [r.id for r in listings.article_page(rows, log, judged, failed, history, sort=sort, order=order).collect()]
        cursor, seen = None, []
        while page := listings.article_page(rows, log, judged, failed, history, sort=sort, order=order, page_size=2, cursor=cursor).collect():
            seen += [r.id for r in page]
            cursor = {name: page[-1][name] for name, _ in keys}
        assert seen == whole
    public = listings.public_page(rows, judged, tagged, words, page_size=1).collect()
    first = rows.filter(F.col("id") == public[0].id).withColumn("item_time", item_time())
    rest = listings.public_page(rows, judged, tagged, words, cursor=paging.cursor_of(first, listings.PUBLIC_KEYS)).collect()
    assert [r.id for r in [*public, *rest]] == [r.id for r in listings.public_page(rows, judged, tagged, words).collect()]
    report = reports.failure_report_page(rows, log, judged, failed, page_size=2).first()
    assert ([(i.article_id, i.stage) for i in report["items"]], report.total) == ([(1, "fetch"), (4, "evaluation")], 3)
    report = reports.failure_report_page(rows, log, judged, failed, page_size=2, cursor=report.cursor.asDict()).first()
    assert ([(i.article_id, i.stage, i.title) for i in report["items"]], report.total) == ([(5, "fetch", rows.filter("id = 5").first().title)], 3)
    tags_page = listings.tag_listing(words, tagged, limit=2).first()
    assert ([i.name for i in tags_page["items"]], tags_page.total) == (["AI", "web"], 3)
    assert [i.name for i in listings.tag_listing(words, tagged, limit=2, cursor=tags_page.cursor.asDict()).first()["items"]] == ["Off"]


def test_only_chosen_content_is_shuffled_and_once(spark):
    rows, log, judged, _, tagged, words = state(spark)
    many = log.unionByName(log.withColumns({"id": F.col("id") + 1000, "article_id": F.lit(99).cast("bigint")}))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        frame_of = publishing.publishable(rows, many, judged, tagged, words)
        plan = frame_of._jdf.queryExecution().executedPlan().toString()
        found = frame_of.collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(_content_id" in line]
    assert len(moved) == 1 and plan.count("bitmap#") > 0 and "BroadcastHashJoin" in plan
    below = plan[plan.index(moved[0]):]
    assert "getbit" in below or "bit_get" in below
    assert sorted(r.id for r in found) == sorted(r.id for r in publishing.publishable(rows, log, judged, tagged, words).collect())


def test_publishing_writes_what_changed(spark, tmp_path):
    rows, log, judged, _, tagged, words = state(spark)
    many = spark.range(10, 310).select(F.col("id"), F.concat(F.lit("s"), "id").alias("n"))
    base = rows.filter("id = 2").drop("id", "slug", "title", "url", "normalized_url")
    more = many.crossJoin(base).select("*", F.col("n").alias("slug"), F.col("n").alias("title"), F.col("n").alias("url"), F.col("n").alias("normalized_url")).select(rows.columns)
    content = log.filter("id = 3").drop("id", "article_id").crossJoin(many).select("*", (F.col("id") + 1000).alias("new"), F.col("id").alias("article_id")).drop("id", "n").withColumnRenamed("new", "id").select(log.columns)
    verdict = judged.filter("article_id = 2").limit(1).drop("id", "article_id").crossJoin(many).select("*", F.col("id").alias("article_id")).drop("n").select(judged.columns)
    everything = rows.unionByName(more), log.unionByName(content), judged.unionByName(verdict), tagged, words
    folder = str(tmp_path)
    first = publishing.publishable_rows(*everything)
    n = first.count()
    assert publishing.publish_changes(first, everything[1], folder) == {"written": n, "gone": 0, "kept": 0} and n > 300
    changed = everything[0].withColumn("title", F.when(F.col("id").between(20, 28), F.lit("New")).otherwise(F.col("title"))).filter("id <> 30")
    second = publishing.publishable_rows(changed, *everything[1:])
    assert publishing.publish_changes(second, everything[1], folder) == {"written": 9, "gone": 1, "kept": n - 10}
    stored = spark.read.parquet(str(next(tmp_path.glob("published/rows/batch=2"))))
    assert stored.filter("NOT gone").count() < 9 + n // 4 and stored.filter("gone").count() == 1
    pick = lambda frame_of: sorted((r.slug, r.record, r.document) for r in frame_of.collect())
    whole = publishing.snapshot_rows(publishing.publishable(changed, *everything[1:]))
    assert pick(publishing.published_articles(spark, folder)) == pick(whole)
    lines = [r.value for r in spark.read.text(f"{folder}/index-2").collect()]
    assert lines == [r.record for r in whole.orderBy(F.desc("item_time"), F.desc("id")).collect()]
    assert publishing.publish_changes(second, everything[1], folder) == {"written": 0, "gone": 0, "kept": n - 1}
    # an article that comes back is written again
    assert publishing.publish_changes(first, everything[1], folder) == {"written": 10, "gone": 0, "kept": n - 10}


def test_search_by_index_is_the_full_scan(spark, tmp_path):
    draw = random.Random(3)
    words = ["Alpha", "beta", "100%", "snake_case", "back\\slash", "É", "é", "中文标题", "a", "ab", "abc", ""]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 4))) if i % 17 else None, f"https://e.com/{i}", draw.choice(["src0", "Src1", None])) for i in range(600)]
    table, folder = spark.createDataFrame(rows, "id bigint, title string, url string, source_name string"), str(tmp_path)
    search.build_index(table, folder, buckets=40)
    for needle in ["alpha", "ALPHA beta", "pha%bet", "snake_case", "100%", "_00%", "é", "É", "中文标", "k\\s", "a", "ab", "abc a", "src1", "com/59", "/599", "%", "zzz", " ", "a_c", "e.com/1_7"]:
        got = sorted(r.id for r in search.search(spark, folder, needle).collect())
        want = sorted(r.id for r in filters.matching(table, needle.strip() and needle, *search.SEARCHED).collect())
        assert got == want, needle
    found = search.search(spark, folder, "com/599")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert search.candidates(spark, folder, "com/599").count() == 1 and re.search(r"PartitionFilters: \[[^]]*bucket", plan)
    assert search.candidates(spark, folder, "a_c") is None and search.needle_grams("ab%cde_FGHI") == ["cde", "fgh", "ghi"]


def test_failed_articles_are_found_without_sorting_a_log(spark):
    rows, log, judged, failed, *_ = state(spark)
    ids = filters.failed_article_ids(log, judged, failed)
    assert sorted(r.article_id for r in ids.collect()) == [1, 4, 5]
    assert "SortAggregate" not in plan_of(ids)
    # a failure before the latest success counts no more; an id alone decides what is latest
    back = fetches(spark, dict(id=6, article_id=1, content="b"), dict(id=3, article_id=9, status="failed"), dict(id=2, article_id=9))
    assert sorted(r.article_id for r in filters.failed_article_ids(log.unionByName(back), judged, failed).collect()) == [4, 5, 9]


def test_details_write_ids_only(spark, monkeypatch):
    rows, log, judged, _, tagged, words = state(spark)
    kept, write = [], listings.written
    monkeypatch.setattr(listings, "written", lambda frame, purpose: kept.append(frame.columns) or write(frame, purpose))
    asked = spark.createDataFrame([("s-t1",), ("s-t1",), ("s-t3",), ("s-t4",), ("none",)], "slug string")
    got = listings.public_detail(rows, log, judged, tagged, words, asked)
    assert sorted((r.id, r.content, r.summary, r.tags) for r in got.collect()) == [(1, " body ", "new", ["AI", "web"]), (3, "b3", None, [])]
    assert kept == [["id"]]


def test_ids_beyond_the_bitmaps_take_their_own_content(spark):
    far = 1 << 30
    rows = articles(spark, *[article(i, status="accepted", title=f"T{i}") for i in (1, far + 1, 2)])
    log = fetches(
        spark, dict(id=5, article_id=1, content="old"), dict(id=far + 5, article_id=far + 1, content="far"), dict(id=7, article_id=1, content="new"),
        dict(id=far + 7, article_id=1, status="failed"), dict(id=6, article_id=2, content="two"),
    )
    words, judged = vocabulary(spark, "AI"), evaluations(spark, dict(id=1, article_id=1), dict(id=2, article_id=far + 1))
    tagged = frame(spark, schemas.ARTICLE_TAGS)
    asked = spark.createDataFrame([("s-t1",)], "slug string")
    assert [(r.id, r.content) for r in listings.public_detail(rows, log, judged, tagged, words, asked).collect()] == [(1, "new")]
    every = listings.public_detail(rows, log, judged, tagged, words)
    assert {r.id: r.content for r in every.collect()} == {1: "new", far + 1: "far", 2: "two"}
    shown_rows = publishing.publishable(rows, log, judged, tagged, words).collect()
    assert {r.id: r.content for r in shown_rows} == {1: "new", far + 1: "far"}


def test_publishing_chooses_on_ids(spark, monkeypatch):
    rows, log, judged, _, tagged, words = state(spark)
    kept, write = [], publishing.written
    monkeypatch.setattr(publishing, "written", lambda frame, purpose: kept.append(frame.columns) or write(frame, purpose))
    assert sorted(r.id for r in publishing.publishable_rows(rows, log, judged, tagged, words).collect()) == [1, 2]
    assert kept[0] == ["id", "fetch_id"]


def test_ids_that_share_bits(spark):
    ids = spark.createDataFrame([(0,), (1,), (32_768,), (32_769,), (1 << 40,), (None,)], "id bigint")
    asked = spark.range(0, 70_000).unionByName(spark.createDataFrame([(1 << 40,), ((1 << 40) + 1,), (None,)], "id bigint"))
    exact = membership.possibly_in(asked, "id", membership.id_bitmaps(ids, "id"))
    # with 2^30 bits, 2^40 falls on 0 and 2^40 + 1 on 1
    assert sorted(r.id for r in exact.collect()) == [0, 1, 32_768, 32_769, 1 << 40, (1 << 40) + 1]
    few = membership.possibly_in(asked, "id", membership.id_bitmaps(ids, "id", 64), 64)
    assert {r.id for r in few.collect()} >= {0, 1, 32_768, 32_769, 1 << 40}
    assert membership.possibly_in(asked, "id", membership.id_bitmaps(ids.limit(0), "id")).count() == 0


def test_page_dates(spark):
    pages = {
        '<meta name="date" content="2025-01-02"><meta property="og:updated_time" content="2025-01-03">': ("meta", "2025-01-03T00:00:00"),
        '<meta name="date" content="soon"><meta name="date" content="2025-01-02">': (None, None),
        "<META content='2025-01-02' NAME=date>": ("meta", "2025-01-02T00:00:00"),
        '<!-- <meta name="date" content="2025-01-02"> -->': (None, None),
        '<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@graph": [{"dateCreated": "2025-01-04"}]}]</script>':
            ("json_ld", "2025-01-04T00:00:00"),
        'x = "{\\"publishedOn\\":\\"2025-06-27T06:05:00.000Z\\"}"': ("script", "2025-06-27T06:05:00"),
        '<time datetime="">x</time><time>2025-01-05</time>': ("time_tag", "2025-01-05T00:00:00"),
        "<p>2025-01-05</p>": (None, None),
        "": (None, None),
    }
    rows = spark.createDataFrame(list(enumerate(pages)), "n int, html string")
    got = {r.n: (r.published_by, shown(r.published_at)) for r in page_dates.with_published_at(rows).collect()}
    assert [got[i] for i in range(len(pages))] == list(pages.values())
    assert page_dates.with_published_at(rows).select(F.count("*")).first()[0] == len(pages)
