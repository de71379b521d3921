"""Publication times out of pages; verdicts over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import tables as t
from gleaner.catalog.oracle_tables import iso
from gleaner.catalog.registry import query
from gleaner.functions.times import first_time, iso_z
from gleaner.operators import page_dates, verdicts

# --- publication times -------------------------------------------------------------


def dated_pages(spark, sf):
    """Pages with a date in one of ten dialects, taken from the event of the same number."""
    times = t.read(spark, sf, "events").select(F.col("event_id").alias("page_id"), t.ts("ts").alias("ts"))
    pages = t.read(spark, sf, "pages").join(times, "page_id")
    iso_text, wrong = iso_z(F.col("ts")), F.lit("1999-01-01")
    day = F.date_format("ts", "yyyy-MM-dd")
    rfc = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")

    def text(pattern, *values):
        parts = pattern.split("{}")
        return F.concat(*[p for pair in zip(map(F.lit, parts), [*values, F.lit("")]) for p in pair])

    snippets = [
        text('<time datetime="{}">x</time><meta content="{}" property="article:published_time">', wrong, iso_text),
        text('<meta name="date" content="soon"><meta name="pubdate" content=\'{}\'/>', rfc),
        text('<script type="application/ld+json">{{"x":1}}</script><script type="application/ld+json">'
             '[[{{"name":"n"}}],{{"@graph":[{{"dateCreated":"{}"}}]}},{{"datePublished":"no","dateModified":"{}"}}]</script>',
             wrong, iso_text),
        text('<script>var s={{"publishedOn":"never","publishedAt" : "{}"}};</script>', day),
        text('<script>s="{{\\"datePublished\\":\\"{}\\"}}"</script><time>{}</time>', iso_text, wrong),
        text('<time class="a" datetime="">soon</time><time>\n <b>{}</b>\n</time>', day),
        text('<!-- <meta property="og:updated_time" content="{}"> --><time datetime="{}">then</time>', wrong, rfc),
        text('<script type="application/ld+json">{{"datePublished": 5}}</script><meta itemprop="dateModified" content="{}">', day),
        text("<script>var m='<meta name=\"date\" content=\"{}\">'</script><TIME DATETIME='{}'></TIME>", wrong, day),
        text("<p>undated {}</p>", wrong),
    ]
    snippets = [F.replace(F.replace(s, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")) for s in snippets]
    snippet = F.element_at(F.array(*snippets), (F.col("page_id") % 10 + 1).cast("int"))
    html = F.replace("html", F.lit("</article>"), F.concat(snippet, F.lit("</article>")))
    return pages.select("page_id", html.alias("html"))


_BY = """CASE WHEN page_id % 10 IN (0, 1, 7) THEN 'meta' WHEN page_id % 10 = 2 THEN 'json_ld' WHEN page_id % 10 IN (3, 4) THEN 'script'
              WHEN page_id % 10 IN (5, 6, 8) THEN 'time_tag' END"""


@query(f"""
    SELECT page_id, {_BY} AS published_by,
           CASE WHEN page_id % 10 IN (0, 1, 2, 4, 6) THEN {iso('ts')} WHEN page_id % 10 <> 9 THEN {iso("date_trunc('day', ts)")} END AS published_at
    FROM pages JOIN events ON event_id = page_id""")
def page_publication_times(spark, sf):
    return page_dates.with_published_at(dated_pages(spark, sf)).select("page_id", "published_by", "published_at")


@query(f"""
    SELECT page_id, CASE page_id % 10 WHEN 3 THEN {iso("date_trunc('day', ts)")} WHEN 4 THEN {iso('ts')} WHEN 2 THEN {iso('ts')} END AS script_time
    FROM pages JOIN events ON event_id = page_id WHERE page_id % 10 <> 2
    UNION ALL SELECT page_id, '1999-01-01T00:00:00Z' FROM pages JOIN events ON event_id = page_id WHERE page_id % 10 = 2""")
def script_times(spark, sf):
    """Script rule alone: on JSON-LD pages it sees the first date in the text."""
    return dated_pages(spark, sf).select("page_id", page_dates.script_time(F.col("html")).alias("script_time"))


@query(f"""
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-01-02T00:00:00Z' WHEN 1 THEN '2024-03-04T05:06:07Z' WHEN 2 THEN '2024-01-05T00:00:00Z' END AS linked_time
    FROM documents""")
def linked_data_times(spark, sf):
    """JSON-LD blocks around document text."""
    body = F.to_json(F.struct("text"))
    text = F.substr(body, F.lit(2), F.length(body) - 2)
    forms = F.array(
        F.concat(F.lit("{"), text, F.lit(', "dateModified": "2024-01-03", "datePublished": "2024-01-02"}')),
        F.concat(F.lit('[[{"dateCreated": "2024-01-01"}], {"@graph": [{"dateCreated": "2020-01-01"}],'), text,
                 F.lit(', "dateModified": "Mon, 04 Mar 2024 05:06:07 GMT"}]')),
        F.concat(F.lit('{"@graph": [{'), text, F.lit('}, {"dateCreated": "2024-01-05"}], "datePublished": ["2020-01-01"]}')),
        F.concat(F.lit('{"datePublished": "2024-01-06", '), text),
    )
    blocks = F.array(F.lit("not json"), F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int")))
    frame = t.read(spark, sf, "documents").select("doc_id", blocks.alias("blocks"))
    return frame.select("doc_id", first_time(page_dates.linked_data_dates("blocks")).alias("linked_time"))


# --- verdicts --------------------------------------------------------------------

def replies(spark, sf):
    """One reply per document: valid ones and every kind of fault."""
    k = F.col("doc_id")
    whole = (
        '{"decision": "%s", "content_type": "tooling_note", "summary": " about @ ", "tags": [%s], '
        '"suggested_tags": [" New  One ", "new one", "", "@"], "recommendation_reason": "%s"}'
    )
    forms = [
        whole % ("accept", '" AI ", " "', " good "),
        whole % ("maybe", '"AI"', "good"),
        whole % ("reject", '" "', "good"),
        whole % ("reject", "1", " "),
        (whole % ("reject", '"AI"', "good")).replace('"summary": " about @ ", ', ""),
        (whole % ("reject", '"AI"', "good"))[:-1] + ', "score": 1}',
        "```json\n" + (whole % ("low_confidence", '"AI"', "good")) + "\n```",
        '["accept"]',
        "no reply @",
        "",
    ]
    raw = F.replace(F.element_at(F.array(*map(F.lit, forms)), (k % 10 + 1).cast("int")), F.lit("@"), F.col("source"))
    return t.read(spark, sf, "documents").select("doc_id", raw.alias("raw"))


@query("""
    SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'decision is unknown' WHEN 2 THEN 'tags must not be empty'
             WHEN 3 THEN 'recommendation_reason must not be empty; tags must be a list of strings'
             WHEN 4 THEN 'summary must be a string; summary must not be empty' WHEN 5 THEN 'unknown keys'
             WHEN 7 THEN 'reply is not a JSON object' WHEN 8 THEN 'reply is not valid JSON' WHEN 9 THEN 'empty reply' END AS violation,
           CASE doc_id % 10 WHEN 0 THEN 'accept' WHEN 6 THEN 'low_confidence' END AS decision,
           CASE WHEN doc_id % 10 IN (0, 6) THEN 'about ' || source END AS summary, CASE WHEN doc_id % 10 IN (0, 6) THEN 'AI' END AS tags,
           CASE WHEN doc_id % 10 IN (0, 6) THEN 'New  One|' || source END AS suggested_tags,
           CASE WHEN doc_id % 10 IN (0, 6) THEN 'good' END AS reason
    FROM documents""")
def verdict_check(spark, sf):
    checked = verdicts.with_verdict(replies(spark, sf))
    return checked.select(
        "doc_id", "violation", "verdict.decision", "verdict.summary", "verdict.tags", "verdict.suggested_tags",
        F.col("verdict.recommendation_reason").alias("reason"),
    )


@query("""
    WITH base AS (SELECT a.id, a.title, a.url, a.source_name, a.source_tags, f.content FROM articles a JOIN fetches f ON f.article_id = a.id
                  WHERE f.id = (SELECT MAX(id) FROM fetches x WHERE x.article_id = a.id AND x.status = 'success')),
         vocab AS (SELECT string_agg('  "' || name || '"', ',' || chr(10) ORDER BY lower(name), name) AS names FROM vocabulary WHERE status = 'active')
    SELECT id, '# Title' || chr(10) || title || chr(10) || chr(10) || '# URL' || chr(10) || url || chr(10) || chr(10) || '# Source Name' || chr(10)
             || source_name || chr(10) || chr(10) || '# Source Tags' || chr(10) || '["' || source_tags || '"]' || chr(10) || chr(10)
             || '# Markdown' || chr(10) || content AS message,
           sha256('Judge.' || chr(10) || chr(10) || '## 当前正式标签词库' || chr(10) || chr(10)
             || '只能从以下正式标签中选择 `tags`。如果没有合适标签，`tags` 仍需至少选择一个最接近的正式标签，并在 `suggested_tags` 中提出希望新增的标签。'
             || chr(10) || chr(10) || '```json' || chr(10) || '[' || chr(10) || names || chr(10) || ']' || chr(10) || '```'
             || chr(10) || chr(10) || '## Few-shot JSON examples' || chr(10) || chr(10) || '{"a": 1}' || chr(10) || chr(10) || '{"b": 2}') AS prompt_digest
    FROM base, vocab""")
def evaluation_requests(spark, sf):
    with_content, _ = verdicts.scorable(t.articles(spark, sf), t.fetches(spark, sf))
    prompt = verdicts.system_prompt("Judge.", t.vocabulary(spark, sf), ['{"a": 1}\n', '{"b": 2}'])
    requests = verdicts.with_messages(with_content, prompt)
    return requests.select(
        "id", F.col("messages")[1]["content"].alias("message"), F.sha2(F.col("messages")[0]["content"], 256).alias("prompt_digest")
    )


def rule_scorer(messages):
    """Offline scorer: judges by the length of the body, with some bad first replies.

    Lengths divisible by 5 need a second try, by 7 never give a valid reply, by
    11 fail as calls.
    """
    size = len(messages[1]["content"].split("# Markdown\n", 1)[1])
    if size % 11 == 0:
        raise RuntimeError("scorer unavailable")
    if size % 7 == 0:
        return verdicts.reply_json(decision="accept")
    if size % 5 == 0 and len(messages) == 2:
        return "not json"
    return verdicts.reply_json(
        decision=("accept", "reject", "low_confidence")[size % 3], content_type="technical_article",
        summary=f"{size} characters", tags=["AI"], recommendation_reason="measured",
    )


def _requests(spark, sf):
    none = F.lit("")
    docs = t.read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), none.alias("title"), none.alias("url"), F.col("source").alias("source_name"),
        F.array("lang").alias("source_tags"), F.col("text").alias("content"),
    )
    return verdicts.with_messages(docs).select("id", "messages")


def _evaluated(spark, sf):
    return verdicts.evaluate(_requests(spark, sf), rule_scorer, "rules", F.lit("2025-01-01").cast("timestamp"), system="Judge.")


_SCORED = """
    sized AS (SELECT doc_id, length(text) AS n FROM documents),
    scored AS (SELECT doc_id, n, CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN 3 WHEN n % 5 = 0 THEN 2 ELSE 1 END AS attempts,
                 CASE WHEN n % 11 <> 0 AND n % 7 <> 0 THEN ['accept', 'reject', 'low_confidence'][n % 3 + 1] END AS decision FROM sized)"""
_FAULT = "'content_type must be a string; summary must be a string; recommendation_reason must be a string; content_type is unknown; " \
         "summary must not be empty; recommendation_reason must not be empty; tags must be a list of strings; tags must not be empty'"


@query(f"""
    WITH {_SCORED}
    SELECT doc_id AS id, decision, attempts, CASE WHEN decision IS NOT NULL THEN n || ' characters' END AS summary,
           CASE WHEN n % 11 = 0 THEN 'scorer unavailable' WHEN n % 7 = 0 THEN {_FAULT} END AS error
    FROM scored""")
def scored(spark, sf):
    return verdicts.score(_requests(spark, sf), rule_scorer, system="Judge.").select("id", "verdict.decision", "attempts", "verdict.summary", "error")


@query(f"""
    WITH {_SCORED}
    SELECT doc_id AS article_id, attempts, CASE WHEN n % 11 = 0 THEN 'scorer unavailable' ELSE {_FAULT} END AS error,
           CASE WHEN n % 11 <> 0 THEN '{{"decision": "accept"}}' END AS raw_response FROM scored WHERE decision IS NULL""")
def failed_verdicts(spark, sf):
    rows = _evaluated(spark, sf)["failures"]
    return rows.select("article_id", "attempts", "error", "raw_response")


@query(f"""
    WITH {_SCORED}
    SELECT COUNT(*) AS attempted, COUNT(*) FILTER (WHERE decision = 'accept') AS accepted, COUNT(*) FILTER (WHERE decision = 'reject') AS rejected,
           COUNT(*) FILTER (WHERE decision = 'low_confidence') AS low_confidence, COUNT(*) FILTER (WHERE decision IS NULL) AS failed
    FROM scored""")
def evaluation_counters(spark, sf):
    return _evaluated(spark, sf)["counters"]


@query("""
    SELECT id, EXISTS (SELECT 1 FROM fetches f WHERE f.article_id = a.id AND f.status = 'success') AS scorable FROM articles a WHERE status = 'candidate'""")
def scorable_articles(spark, sf):
    candidates = t.articles(spark, sf).filter("status = 'candidate'")
    with_content, without = verdicts.scorable(candidates, t.fetches(spark, sf))
    return with_content.select("id", F.lit(True).alias("scorable")).unionByName(
        without.select("id", F.lit(False).alias("scorable"))
    )
