"""Evaluation as a table function: requests, scoring with repair, checking, routing."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.constants import (
    CONTENT_TYPES,
    DECISIONS,
    FEW_SHOT_HEADING,
    MAX_ATTEMPTS,
    RETRY_INTRO,
    RETRY_OUTRO,
    RETRY_PREVIOUS,
    VOCABULARY_HEADING,
)
from gleaner.functions.text import evaluator_input, normalize_tag, strip, strip_fences
from gleaner.operators.latest import latest_ids, with_latest_content
from gleaner.operators.membership import id_bitmaps, possibly_in
from gleaner.session import path_exists, shared_folder, written

VERDICT_KEYS = ["decision", "content_type", "summary", "tags", "suggested_tags", "recommendation_reason"]
_VERDICT = (
    "decision string, content_type string, summary string, tags array<string>, "
    "suggested_tags array<string>, recommendation_reason string"
)
Scorer = Callable[[list[dict[str, str]]], str]


# --- checking ------------------------------------------------------------------

def _distinct_names(names: Column) -> Column:
    """Trimmed names, the first of each normalised name."""
    cleaned = F.filter(F.transform(names, strip), lambda n: n != "")
    keys = F.transform(cleaned, normalize_tag)
    return F.filter(cleaned, lambda n, i: F.array_position(keys, normalize_tag(n)) == i + 1)


def with_verdict(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``raw_json``, ``verdict`` and ``violation`` to rows with a raw reply.

    Exactly one of verdict and violation is set.  Unknown keys, wrong types,
    unknown enum values and blank texts are violations.
    """
    parsed = F.col("_v")
    fields = F.from_json("raw_json", _VERDICT)

    def kind(key: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant")), F.lit("missing"))

    def rule(broken: Column, message: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.lit(message))

    strings = ["decision", "content_type", "summary", "recommendation_reason"]
    rules = [
        rule(F.size(F.array_except(F.json_object_keys("raw_json"), F.array(*map(F.lit, VERDICT_KEYS)))) > 0,
             "unknown keys"),
        *[rule(kind(key) != "STRING", f"{key} must be a string") for key in strings],
        rule(~F.col("_f.decision").isin(DECISIONS), "decision is unknown"),
        rule(~F.col("_f.content_type").isin(CONTENT_TYPES), "content_type is unknown"),
        rule(strip(F.col("_f.summary")) == "", "summary must not be empty"),
        rule(strip(F.col("_f.recommendation_reason")) == "", "recommendation_reason must not be empty"),
        rule(~kind("tags").isin("ARRAY<STRING>", "ARRAY<VOID>"), "tags must be a list of strings"),
        rule(F.size("_tags") == 0, "tags must not be empty"),
        rule(~kind("suggested_tags").isin("ARRAY<STRING>", "ARRAY<VOID>", "missing"),
             "suggested_tags must be a list of strings"),
    ]
    violation = (
        F.when(F.col(raw).isNull() | (F.col(raw) == ""), F.lit("empty reply"))
        .when(F.col("raw_json").isNull(), F.lit("reply is not valid JSON"))
        .when(~strip(F.col("raw_json")).startswith("{"), F.lit("reply is not a JSON object"))
        .otherwise(F.nullif(F.array_join(F.array_compact(F.array(*rules)), "; "), F.lit("")))
    )
    verdict = F.struct(
        F.col("_f.decision").alias("decision"),
        F.col("_f.content_type").alias("content_type"),
        strip(F.col("_f.summary")).alias("summary"),
        F.col("_tags").alias("tags"),
        _distinct_names(F.coalesce("_f.suggested_tags", F.array().cast("array<string>"))).alias("suggested_tags"),
        strip(F.col("_f.recommendation_reason")).alias("recommendation_reason"),
    )
    return (
        replies.withColumn("_text", strip_fences(F.col(raw)))
        .withColumn("_v", F.try_parse_json("_text"))
        .withColumn("raw_json", F.when(F.col("_v").isNotNull(), F.col("_text")))
        .withColumn("_f", F.when(strip(F.col("raw_json")).startswith("{"), fields))
        .withColumn("_tags", F.filter(F.transform("_f.tags", strip), lambda t: t != ""))
        .withColumn("violation", violation)
        .withColumn("verdict", F.when(F.col("violation").isNull(), verdict))
        .drop("_text", "_v", "_f", "_tags")
    )


# --- requests ------------------------------------------------------------------

def system_prompt(prompt: str, vocabulary: DataFrame, few_shots: Sequence[str] = ()) -> Column:
    """Prompt, active vocabulary and examples as one value (a scalar subquery).

    The vocabulary is part of every request, so it has to fit one anyway.
    """
    names = F.transform(
        F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name"))),
        lambda t: F.concat(F.lit("  "), F.to_json(F.array(t["name"])).substr(F.lit(2), F.length(F.to_json(F.array(t["name"]))) - 2)),
    )
    listed = F.concat(
        F.lit(VOCABULARY_HEADING + "```json\n[\n"), F.array_join(names, ",\n"), F.lit("\n]\n```")
    )
    section = vocabulary.filter(F.col("status") == "active").agg(
        F.when(F.count(F.lit(1)) > 0, listed).otherwise(F.lit("")).alias("section")
    )
    examples = FEW_SHOT_HEADING + "\n\n".join(shot.strip() for shot in few_shots) if few_shots else ""
    return F.concat(F.lit(prompt), section.scalar(), F.lit(examples))


def user_message(title: Column, url: Column, source: Column, tags: Column, content: Column, most_chars: int | None = None) -> Column:
    """Article facts and the body as one message; the body is cut only where ``most_chars`` is given."""
    tag_json = F.concat(
        F.lit("["), F.array_join(F.transform(tags, lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", "")), ", "),
        F.lit("]"),
    )
    return F.concat(
        F.lit("# Title\n"), title,
        F.lit("\n\n# URL\n"), url,
        F.lit("\n\n# Source Name\n"), source,
        F.lit("\n\n# Source Tags\n"), tag_json,
        F.lit("\n\n# Markdown\n"), evaluator_input(content, most_chars),
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def repair_message(previous_raw: Column, previous_error: Column) -> Column:
    return F.concat(
        F.lit(RETRY_INTRO), F.coalesce(previous_error, F.lit("unknown error")), F.lit("\n\n" + RETRY_PREVIOUS),
        previous_raw, F.lit("\n\n" + RETRY_OUTRO),
    )


def prompt_text(prompt: str, vocabulary: DataFrame, few_shots: Sequence[str] = ()) -> str:
    """The system prompt as text, to be handed to the scorer once (``score(system=...)``); it has to fit one request."""
    return vocabulary.sparkSession.range(1).select(system_prompt(prompt, vocabulary, few_shots).alias("prompt")).first().prompt


def with_messages(articles: DataFrame, prompt: Column | None = None, most_chars: int | None = None) -> DataFrame:
    """Add ``messages`` to rows with title, url, source_name, source_tags and content.

    Without a prompt they are the user's message alone, for a scorer that is given the prompt once.
    """
    user = user_message(*[F.col(c) for c in ("title", "url", "source_name", "source_tags", "content")], most_chars)
    system = [] if prompt is None else [_message("system", prompt)]
    return articles.withColumn("messages", F.array(*system, _message("user", user)))


# --- scoring -------------------------------------------------------------------

_REPLY = StructType([StructField("raw", StringType()), StructField("error", StringType())])


def _scoring(scorer: Scorer, system: str | None):
    first = [] if system is None else [{"role": "system", "content": system}]

    def score(messages: pd.Series) -> pd.DataFrame:
        rows = []
        for items in messages:
            if items is None:
                rows.append((None, None))
                continue
            try:
                rows.append((scorer([*(dict(item) for item in first), *(dict(item) for item in items)]), None))
            except Exception as problem:  # a call that fails is a failed attempt, not a failed job
                rows.append((None, str(problem)))
        return pd.DataFrame(rows, columns=["raw", "error"])

    return F.pandas_udf(score, _REPLY).asNondeterministic()


def _attempt(open_rows: DataFrame, scorer: Scorer, system: str | None) -> DataFrame:
    """Replies to rows with ``messages``, the reply before (``said``) and its error (``because``)."""
    repeat = F.array(_message("user", repair_message(F.col("said"), F.col("because"))))
    sent = F.when(F.col("said").isNull(), F.col("messages")).otherwise(F.concat("messages", repeat))
    asked = open_rows.withColumn("_reply", _scoring(scorer, system)(sent))
    checked = with_verdict(asked.withColumn("_got", F.col("_reply.raw")), "_got")
    empty = F.col("_reply.error").isNull() & (F.coalesce("_got", F.lit("")) == "")
    return checked.select(
        "_key", F.coalesce(F.nullif("_got", F.lit("")), "said").alias("raw"),
        F.coalesce("_reply.error", F.when(empty, F.lit("empty AI response content")), F.col("violation")).alias("error"),
        F.when(F.col("verdict").isNotNull(), F.col("raw_json")).alias("raw_json"), "verdict",
    )


def score(
    requests: DataFrame, scorer: Scorer, max_attempts: int = MAX_ATTEMPTS, key: str = "id", folder: str | None = None,
    calls_per_task: int | None = None, system: str | None = None,
) -> DataFrame:
    """Score every request, asking again up to ``max_attempts`` times.

    A reply that is invalid is repeated with the reply and its error appended; a
    call that failed repeats what was sent before.  Every attempt is written as a log
    by ``key`` (unique, never null) before the next one, which only the rows that are still
    open go into.  So a task that fails repeats at most its own calls of one attempt
    (``calls_per_task`` bounds them), and a run that is started again on the same ``folder``
    goes on after the last whole attempt.  ``system`` is a prompt that goes before all messages;
    it travels with the scorer, not with the rows.

    Adds ``raw``, ``raw_json``, ``verdict``, ``error`` and ``attempts``.
    """
    spark = requests.sparkSession
    folder = folder or shared_folder(spark, "attempts")
    asked = requests.select(F.col(key).alias("_key"), "messages")
    open_rows = asked.withColumns({"said": F.lit(None).cast("string"), "because": F.lit(None).cast("string")})
    logs: list[DataFrame] = []
    for attempt in range(1, max(1, max_attempts) + 1):
        place = f"{folder}/attempt={attempt}"
        if not path_exists(spark, f"{place}/_SUCCESS"):
            if calls_per_task:
                open_rows = open_rows.repartition(max(1, -(-open_rows.count() // calls_per_task)))
            _attempt(open_rows, scorer, system).write.mode("overwrite").parquet(place)
        log = spark.read.parquet(place)
        logs.append(log.withColumn("attempts", F.lit(attempt)))
        again = log.filter(F.col("verdict").isNull()).select("_key", F.col("raw").alias("said"), F.col("error").alias("because"))
        if again.isEmpty():
            break
        open_rows = asked.join(again, "_key")
    last = functools.reduce(DataFrame.unionByName, logs).groupBy("_key").agg(
        F.max_by(F.struct("raw", "raw_json", "verdict", F.when(F.col("verdict").isNull(), F.col("error")).alias("error"), "attempts"), "attempts").alias("last")
    )
    rest = requests.drop("messages")
    return rest.join(last, F.col(key) == F.col("_key")).select(*rest.columns, "last.*")


# --- routing -------------------------------------------------------------------

def scorable(articles: DataFrame, fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split articles into those with fetched content and those without.

    Only ids are written.  Bitmaps of them keep articles without content, and content nobody
    asked for, out of the one shuffle; ``articles`` are read where they are needed.
    """
    asked = possibly_in(fetches.select("article_id", "id", "status"), "article_id", id_bitmaps(articles, "id"))
    found = written(latest_ids(asked, "article_id", F.col("status") == "success"), "scorable")
    fetched = possibly_in(articles, "id", id_bitmaps(found, "article_id"))
    ready = with_latest_content(fetched, fetches, found=found).drop("fetched_at")
    return ready, articles.join(found, F.col("article_id") == articles["id"], "left_anti")


def accepted_verdicts(scored: DataFrame, model_name: str, evaluated_at: Column) -> DataFrame:
    """Rows for the evaluation log."""
    return scored.filter(F.col("verdict").isNotNull()).select(
        F.col("id").alias("article_id"), evaluated_at.alias("evaluated_at"), "verdict.*",
        F.lit(model_name).alias("model_name"), "raw_json",
    )


def failed_verdicts(scored: DataFrame, failed_at: Column) -> DataFrame:
    """Rows for the log of failed evaluations."""
    return scored.filter(F.col("verdict").isNull()).select(
        F.col("id").alias("article_id"), failed_at.alias("failed_at"),
        F.coalesce("error", F.lit("AI evaluation failed")).alias("error"), "attempts",
        F.col("raw").alias("raw_response"),
    )


def evaluate(
    requests: DataFrame, scorer: Scorer, model_name: str, at: Column, max_attempts: int = MAX_ATTEMPTS, system: str | None = None
) -> dict[str, DataFrame]:
    """Score requests once and route what came back: ``evaluations``, ``failures``, ``counters``.

    Replies are written before anything reads them, so a call that is paid for is
    made once per attempt, and every article lands in exactly one log.
    """
    scored = written(score(requests, scorer, max_attempts, system=system), "scored")
    return {
        "evaluations": accepted_verdicts(scored, model_name, at),
        "failures": failed_verdicts(scored, at),
        "counters": evaluation_counters(scored),
    }


def evaluation_counters(scored: DataFrame) -> DataFrame:
    decision = F.col("verdict.decision")
    return scored.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(decision == "accept").alias("accepted"),
        F.count_if(decision == "reject").alias("rejected"),
        F.count_if(decision == "low_confidence").alias("low_confidence"),
        F.count_if(F.col("verdict").isNull()).alias("failed"),
    )


def reply_json(**fields: object) -> str:
    """A reply in the expected format; handy for offline scorers."""
    return json.dumps(fields, ensure_ascii=False)
