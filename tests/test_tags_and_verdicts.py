import json
import os

import pytest
from helpers import article, articles, evaluations, fetches, frame, moment, vocabulary
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.operators import tags, verdicts
from gleaner.operators.ids import numbered


def links(spark, *rows):
    return frame(spark, schemas.ARTICLE_TAGS, *rows)


def candidates(spark, *rows):
    return frame(spark, schemas.TAG_CANDIDATES, *[dict(status="pending", reason="r", **r) for r in rows])


def test_unknown_and_suggested_tags_become_candidates(spark):
    judged = evaluations(
        spark,
        dict(id=1, article_id=1, tags=["AI", " ai ", "Brand New", "Off"], suggested_tags=["brand  new", "Idea", "Web"]),
        dict(id=2, article_id=1, tags=["AI"], suggested_tags=["Idea"]),
        dict(id=3, article_id=2, tags=["Known Pending"], suggested_tags=[]),
    )
    words = vocabulary(spark, "AI", "Web", "-Off")
    pending = candidates(spark, dict(id=9, article_id=2, suggested_tag="x", normalized_name="known pending"))
    got = tags.new_tag_candidates(judged, pending, words).orderBy("article_id", "normalized_name").collect()
    assert [(r.article_id, r.evaluation_id, r.suggested_tag, r.reason.split(" ")[-1]) for r in got] == [
        (1, 1, "Brand New", "tags"), (1, 1, "Idea", "新标签建议"), (1, 1, "Off", "tags")]
    linked = tags.sync_links(judged, links(spark, dict(article_id=1, tag_id=2), dict(article_id=5, tag_id=2)), words)
    assert sorted((r.article_id, r.tag_id, r.evaluation_id) for r in linked.collect() if r.article_id == 1) == [(1, 1, 2)]
    assert sorted((r.article_id, r.tag_id) for r in linked.collect()) == [(1, 1), (5, 2)]


def test_public_tags_are_active_and_sorted(spark):
    words = vocabulary(spark, "web", "AI", "Zoo", "-Off")
    rows = articles(spark, article(1), article(2))
    tagged = tags.with_public_tags(rows, links(spark, *[dict(article_id=1, tag_id=i) for i in (1, 2, 3, 4)]), words)
    assert {r.id: r.tags for r in tagged.collect()} == {1: ["AI", "web", "Zoo"], 2: []}


def test_review(spark):
    words = vocabulary(spark, "AI", "-Web")
    waiting = candidates(
        spark,
        dict(id=1, article_id=1, suggested_tag="Brand New", normalized_name="brand new"),
        dict(id=2, article_id=2, suggested_tag="brand  new", normalized_name="brand new"),
        dict(id=3, article_id=1, suggested_tag="web", normalized_name="web"),
        dict(id=4, article_id=3, suggested_tag="x", normalized_name="x"),
        dict(id=5, article_id=3, suggested_tag="y", normalized_name="y"),
        dict(id=6, article_id=3, suggested_tag="z", normalized_name="z"),
    )
    decisions = frame(
        spark, "candidate_id bigint, action string, tag_id bigint, name string",
        dict(candidate_id=1, action="approve"), dict(candidate_id=2, action="approve"), dict(candidate_id=3, action="approve"),
        dict(candidate_id=4, action="approve", tag_id=1), dict(candidate_id=5, action="reject"), dict(candidate_id=6, action="approve", tag_id=77),
    )
    out = tags.review(decisions, waiting, words, links(spark), moment())
    assert {r.id: r.status for r in out["candidates"].collect()} == {
        1: "approved", 2: "approved", 3: "approved", 4: "approved", 5: "rejected", 6: "pending"}
    words_after = {r.name: (r.id, r.slug, r.status) for r in out["vocabulary"].collect()}
    assert words_after == {"AI": (1, "ai", "active"), "Web": (2, "web", "active"), "Brand New": (3, "brand-new", "active")}
    assert sorted((r.article_id, r.tag_id) for r in out["links"].collect()) == [(1, 2), (1, 3), (2, 3), (3, 1)]
    assert [(r.candidate_id, r.error) for r in out["errors"].collect()] == [(6, "tag not found")]


def test_vocabulary_changes(spark):
    changes = frame(
        spark, "ordinal bigint, tag_id bigint, name string, description string, status string",
        dict(ordinal=1, name=" Data  Base "), dict(ordinal=2, name="data-base"), dict(ordinal=3, name="ai"),
        dict(ordinal=4, tag_id=2, name="World Wide Web", description=" d "), dict(ordinal=5, tag_id=2, status="disabled"),
        dict(ordinal=6, tag_id=9, name="Ghost"), dict(ordinal=7, name="Ghost"), dict(ordinal=8, name="  "), dict(ordinal=9, tag_id=1, name="AI"),
    )
    kept, refused = tags.change_vocabulary(vocabulary(spark, "AI", "Web"), changes, moment())
    got = {r.id: (r.name, r.normalized_name, r.slug, r.description, r.status) for r in kept.collect()}
    assert got == {
        1: ("AI", "ai", "ai", "", "active"),
        2: ("World Wide Web", "world wide web", "world-wide-web", "d", "disabled"),
        3: ("Data  Base", "data base", "data-base", "", "active"),
        4: ("Ghost", "ghost", "ghost", "", "active"),
    }
    assert {r.ordinal: r.error for r in refused.collect()} == {
        2: "tag already exists", 3: "tag already exists", 6: "tag not found", 8: "tag name must not be empty"}


def test_bootstrap(spark):
    judged = evaluations(spark, dict(id=1, article_id=1, tags=[" New Tag", "AI", " "]), dict(id=2, article_id=2, tags=["new tag", "New-Tag", "New  Tag"]))
    rows, linked = tags.bootstrap_vocabulary(judged, vocabulary(spark, "AI"))
    assert sorted((r.name, r.normalized_name, r.slug) for r in rows.collect()) == [
        ("New  Tag", "new  tag", "new--tag"), ("New Tag", "new tag", "new-tag")]
    assert len(linked.collect()) == 4


VALID = dict(decision="accept", content_type="tooling_note", summary=" s ", tags=[" AI ", ""], recommendation_reason="r")


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, None),
        ({"suggested_tags": ["A b", "a  B", " ", "c"]}, None),
        ({"summary": " "}, "summary must not be empty"),
        ({"decision": "maybe"}, "decision is unknown"),
        ({"content_type": "poem"}, "content_type is unknown"),
        ({"tags": []}, "tags must not be empty"),
        ({"tags": "AI"}, "tags must be a list of strings; tags must not be empty"),
        ({"tags": [1]}, "tags must be a list of strings"),
        ({"suggested_tags": None}, "suggested_tags must be a list of strings"),
        ({"confidence": 1}, "unknown keys"),
    ],
)
def test_verdict_rules(spark, change, expected):
    row = verdicts.with_verdict(spark.createDataFrame([(json.dumps({**VALID, **change}),)], "raw string")).first()
    assert row.violation == expected
    assert (row.verdict is None) == (expected is not None)
    if change == {}:
        assert (row.verdict.summary, row.verdict.tags, row.verdict.suggested_tags) == ("s", ["AI"], [])
    if "suggested_tags" in change and expected is None:
        assert row.verdict.suggested_tags == ["A b", "c"]


def requests(spark, *contents):
    rows = spark.createDataFrame([(i, "T", "u", "s", ["é"], c) for i, c in enumerate(contents)],
                                 "id bigint, title string, url string, source_name string, source_tags array<string>, content string")
    return verdicts.with_messages(rows, F.lit("P"))


def test_scoring_repairs_invalid_replies(spark):
    def scorer(messages):
        body = messages[1]["content"].split("# Markdown\n")[1]
        if body == "down" or (body == "flaky" and len(messages) == 2):
            if body == "flaky":
                return "not json"
            raise RuntimeError("down")
        if body == "hopeless":
            return ""
        if body == "flaky":
            assert "not json" in messages[2]["content"] and "reply is not valid JSON" in messages[2]["content"]
        return json.dumps(VALID)

    got = {r.id: r for r in verdicts.score(requests(spark, "good", "flaky", "down", "hopeless"), scorer).collect()}
    assert [(got[i].attempts, got[i].verdict.decision if got[i].verdict else None, got[i].error) for i in range(4)] == [
        (1, "accept", None), (2, "accept", None), (3, None, "down"), (3, None, "empty AI response content")]
    assert got[0].raw_json == json.dumps(VALID) and got[2].raw is None


def test_request_messages(spark):
    words = vocabulary(spark, "web", "AI", "-Off")
    prompt = verdicts.system_prompt("P", words, ["{}\n"])
    row = requests(spark, "x" * 60_000).withColumn("p", prompt).first()
    assert '```json\n[\n  "AI",\n  "web"\n]\n```\n\n## Few-shot JSON examples\n\n{}' in row.p
    assert row.messages[1].content.startswith("# Title\nT\n\n# URL\nu\n\n# Source Name\ns\n\n# Source Tags\n[\"é\"]\n\n# Markdown\nx")
    assert len(row.messages[1].content.split("# Markdown\n")[1]) == 60_000
    empty = spark.range(1).select(verdicts.system_prompt("P", words.filter("id > 9"))).first()[0]
    assert empty == "P"


def test_the_prompt_is_handed_over_once(spark):
    words = vocabulary(spark, "AI", "-Web")
    prompt = verdicts.prompt_text("Judge.", words, ["{}"])
    rows = spark.createDataFrame([(1, "t", "u", "s", ["x"], "body")], "id bigint, title string, url string, source_name string, source_tags array<string>, content string")
    both = verdicts.with_messages(rows, verdicts.system_prompt("Judge.", words, ["{}"])).first().messages
    alone = verdicts.with_messages(rows)
    assert [m.role for m in alone.first().messages] == ["user"] and [m.content for m in both] == [prompt, alone.first().messages[0].content]
    scorer = lambda messages: json.dumps(VALID | {"summary": messages[0]["content"] + messages[1]["role"]})
    assert verdicts.score(alone, scorer, system=prompt).first().verdict.summary == prompt.strip() + "user"


def test_no_attempt_is_paid_twice(spark, tmp_path):
    """A worker that dies in the second attempt costs no call of the first one, and the run goes on from there."""
    calls, trap = tmp_path / "calls", tmp_path / "trap"
    trap.write_text("")

    def scorer(messages):
        body = messages[1]["content"].rsplit("\n", 1)[-1]
        with open(calls, "a") as log:
            log.write(f"{body} {len(messages)}\n")
        if len(messages) == 3 and body == "flaky" and trap.exists():
            trap.unlink()
            os._exit(1)
        return json.dumps(VALID) if body == "good" or len(messages) == 3 else "{}"

    asked, folder = requests(spark, "good", "flaky", "other"), str(tmp_path / "attempts")
    with pytest.raises(Exception, match="."):
        verdicts.score(asked, scorer, folder=folder).collect()
    rows = {r.id: r for r in verdicts.score(asked, scorer, folder=folder, calls_per_task=1).collect()}
    assert [r.attempts for _, r in sorted(rows.items())] == [1, 2, 2] and all(r.verdict for r in rows.values())
    made = calls.read_text().split("\n")
    assert made.count("good 2") == made.count("flaky 2") == made.count("other 2") == 1
    # the dead worker's own call of the second attempt is the only one that may come again
    assert made.count("flaky 3") == 2 and made.count("other 3") <= 2 and not (tmp_path / "attempts" / "attempt=3").exists()


def test_routing(spark):
    scored = verdicts.score(requests(spark, "a", "b"), lambda m: json.dumps(VALID) if m[1]["content"].endswith("a") else "{}", max_attempts=1)
    good = verdicts.accepted_verdicts(scored, "m1", moment()).first()
    bad = verdicts.failed_verdicts(scored, moment()).first()
    assert (good.article_id, good.decision, good.model_name) == (0, "accept", "m1")
    assert (bad.article_id, bad.attempts, bad.raw_response) == (1, 1, "{}")
    assert verdicts.evaluation_counters(scored).first().asDict() == dict(attempted=2, accepted=1, rejected=0, low_confidence=0, failed=1)


def test_default_vocabulary(spark):
    from gleaner.default_vocabulary import default_vocabulary

    rows = {r.name: r for r in default_vocabulary(spark, moment()).collect()}
    assert len(rows) == 97 == len({r.slug for r in rows.values()})
    assert (rows["CI/CD"].normalized_name, rows["CI/CD"].slug) == ("ci/cd", "ci-cd")
    assert (rows["Query Optimizer"].normalized_name, rows["Query Optimizer"].slug) == ("query optimizer", "query-optimizer")


def test_ids_are_dense_whatever_the_ordinals(spark):
    rows = spark.createDataFrame([(7, i << 56, "x" * 9) for i in (5, 1, 127, 3)], "k bigint, at bigint, text string")
    top = F.lit((1 << 62) + 1).cast("bigint")
    got = {r.at >> 56: r.id - (1 << 62) for r in numbered(rows, ["at"], top).collect()}
    assert got == {1: 2, 3: 3, 5: 4, 127: 5}
    assert numbered(rows.limit(0), ["at"], top).count() == 0


def test_bootstrap_of_long_tag_lists(spark):
    rows = evaluations(spark, *[dict(id=i, article_id=i, tags=[f"t{i * 150 + k}" for k in range(200)]) for i in (1, 2)])
    added, _ = tags.bootstrap_vocabulary(rows, vocabulary(spark, "t151"))
    found = sorted((r.id, r.name) for r in added.collect())
    assert [i for i, _ in found] == list(range(2, 2 + 349)) and found[0][1] == "t150" and found[-1][1] == "t499"


def test_approval_keeps_slugs_unique(spark):
    known = vocabulary(spark, "CI/CD", "Big Data")
    wanted = ["Big-Data", "a b", "a-b", "A  b", "fresh"]
    rows = spark.createDataFrame(
        [(i, i, i, name, name.lower(), "pending", None, None, None, None) for i, name in enumerate(wanted)],
        "id bigint, article_id bigint, evaluation_id bigint, suggested_tag string, normalized_name string, status string, reason string, "
        "reviewed_at timestamp, created_at timestamp, updated_at timestamp")
    decisions = rows.select(F.col("id").alias("candidate_id"), F.lit("approve").alias("action"), F.lit(None).cast("bigint").alias("tag_id"),
                            F.lit(None).cast("string").alias("name"))
    links = spark.createDataFrame([], "article_id bigint, tag_id bigint, evaluation_id bigint, created_at timestamp")
    done = tags.review(decisions, rows, known, links, moment())
    slugs = [r.slug for r in done["vocabulary"].collect()]
    assert sorted(slugs) == ["a-b", "big-data", "ci/cd", "fresh"]
    assert sorted((r.candidate_id, r.error) for r in done["errors"].collect()) == [(0, "tag already exists"), (2, "tag already exists")]
    assert {r.id: r.status for r in done["candidates"].collect()} == {0: "pending", 1: "approved", 2: "pending", 3: "approved", 4: "approved"}
    assert sorted((r.article_id, r.tag_id) for r in done["links"].collect()) == [(1, 3), (3, 3), (4, 4)]


def test_each_attempt_is_made_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def scorer(messages):
        body = messages[1]["content"].split("# Markdown\n")[1]
        with open(calls, "a") as log:
            log.write(body + "\n")
        return json.dumps(VALID) if body == "good" else ""

    done = verdicts.evaluate(requests(spark, "good", "bad"), scorer, "m", moment(), max_attempts=2)
    assert [r.article_id for r in done["evaluations"].collect()] == [0]
    assert [(r.article_id, r.attempts) for r in done["failures"].collect()] == [(1, 2)]
    assert done["counters"].first().attempted == 2
    with open(calls) as log:
        assert sorted(log.read().split()) == ["bad", "bad", "good"]


def test_scorable_articles_are_told_by_ids(spark, monkeypatch):
    kept, write = [], verdicts.written
    monkeypatch.setattr(verdicts, "written", lambda frame, purpose: kept.append(frame.columns) or write(frame, purpose))
    rows = articles(spark, article(1, source_content="bulk"), article(2), article(3), article((1 << 30) + 2))
    log = fetches(
        spark, dict(id=1, article_id=1, content="old"), dict(id=(1 << 30) + 1, article_id=1, content="new"), dict(id=9, article_id=1, status="failed"),
        dict(id=4, article_id=2, status="failed"), dict(id=5, article_id=3, content="three"), dict(id=6, article_id=99, content="not asked for"),
    )
    ready, without = verdicts.scorable(rows, log)
    assert sorted((r.id, r.content) for r in ready.collect()) == [(1, "new"), (3, "three")]
    assert sorted(r.id for r in without.collect()) == [2, (1 << 30) + 2]
    assert ready.columns == [*rows.columns, "content"] and without.columns == rows.columns
    assert kept == [["article_id", "id"]]
