"""Controlled vocabulary: lookup, linking, review and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.constants import (
    DESCRIPTION_APPROVED_TAG,
    DESCRIPTION_BOOTSTRAP_TAG,
    REASON_SUGGESTED_TAG,
    REASON_TAG_OUTSIDE_VOCABULARY,
)
from gleaner.functions.text import normalize_tag, strip, tag_slug
from gleaner.operators.ids import numbered
from gleaner.operators.latest import latest_ids

_TAG_ROW = ["id", "name", "normalized_name", "slug", "description", "status", "created_at", "updated_at"]


def active_tags(vocabulary: DataFrame) -> DataFrame:
    """Names in use, in case-insensitive order."""
    return vocabulary.filter(F.col("status") == "active").select("id", "name").orderBy(F.lower("name"), "name")


def exploded_tags(evaluations: DataFrame) -> DataFrame:
    """One row per non-blank tag of a verdict; ``origin`` 0 for tags, 1 for suggestions."""
    empty = F.array().cast("array<string>")
    entries = F.concat(
        F.transform(F.coalesce("tags", empty), lambda t: F.struct(F.lit(0).alias("origin"), strip(t).alias("name"))),
        F.transform(
            F.coalesce("suggested_tags", empty), lambda t: F.struct(F.lit(1).alias("origin"), strip(t).alias("name"))
        ),
    )
    rows = evaluations.select(
        F.col("id").alias("evaluation_id"),
        "article_id",
        F.col("evaluated_at").alias("at_time"),
        F.posexplode(F.filter(entries, lambda e: e["name"] != "")).alias("at", "entry"),
    )
    return rows.select(
        "evaluation_id", "article_id", "at_time", "at", "entry.origin", "entry.name",
        normalize_tag(F.col("entry.name")).alias("normalized_name"),
    )


def vocabulary_lookup(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``tag_id`` of the active vocabulary entry, null when there is none.

    No broadcast is forced: Spark broadcasts a vocabulary below its size limit
    and otherwise splits a tag that very many articles share.
    """
    active = vocabulary.filter(F.col("status") == "active").select("normalized_name", F.col("id").alias("tag_id"))
    return tags.join(active, "normalized_name", "left")


def sync_links(evaluations: DataFrame, links: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The article-tag links after new verdicts.

    Every evaluated article loses its links and gets those of its latest verdict.
    """
    newest = evaluations.join(latest_ids(evaluations, "article_id").select("id"), "id", "left_semi")
    hits = vocabulary_lookup(exploded_tags(newest), vocabulary).filter(F.col("tag_id").isNotNull())
    fresh = hits.groupBy("article_id", "tag_id").agg(
        F.max("evaluation_id").alias("evaluation_id"), F.max("at_time").alias("created_at")
    )
    kept = links.join(evaluations.select("article_id").distinct(), "article_id", "left_anti")
    return kept.select("article_id", "tag_id", "evaluation_id", "created_at").unionByName(fresh)


def tag_reason(origin: Column) -> Column:
    return F.when(origin == 0, F.lit(REASON_TAG_OUTSIDE_VOCABULARY)).otherwise(F.lit(REASON_SUGGESTED_TAG))


def new_tag_candidates(evaluations: DataFrame, candidates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tags outside the active vocabulary, to be reviewed.

    One pending row per article and name: the first mention (verdict, tags
    before suggestions, position) unless one is pending already.
    """
    pair = ["article_id", "normalized_name"]
    misses = vocabulary_lookup(exploded_tags(evaluations), vocabulary).filter(F.col("tag_id").isNull())
    order = F.struct("evaluation_id", "origin", "at")
    first = misses.groupBy(*pair).agg(
        F.min_by(F.struct("evaluation_id", "origin", "name", "at_time"), order).alias("f")
    )
    pending = candidates.filter(F.col("status") == "pending").select(*pair)
    return first.join(pending, pair, "left_anti").select(
        "article_id",
        "f.evaluation_id",
        F.col("f.name").alias("suggested_tag"),
        "normalized_name",
        F.lit("pending").alias("status"),
        tag_reason(F.col("f.origin")).alias("reason"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.col("f.at_time").alias("created_at"),
        F.col("f.at_time").alias("updated_at"),
    )


def public_tags(links: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Active tag names of every article, in case-insensitive order.

    A list is as long as the tags of one article, which are distinct vocabulary
    entries.
    """
    active = vocabulary.filter(F.col("status") == "active").select(F.col("id").alias("tag_id"), "name")
    named = links.select("article_id", "tag_id").join(active, "tag_id")
    sorted_names = F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name")))
    return named.groupBy("article_id").agg(F.transform(sorted_names, lambda t: t["name"]).alias("tags"))


def with_public_tags(frame: DataFrame, links: DataFrame, vocabulary: DataFrame, key: str = "id") -> DataFrame:
    """Add ``tags``; articles without any have an empty list."""
    tags = public_tags(links, vocabulary).withColumnRenamed("article_id", "_tagged")
    return (
        frame.join(tags, F.col(key) == F.col("_tagged"), "left")
        .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        .drop("_tagged")
    )


def review(
    decisions: DataFrame, candidates: DataFrame, vocabulary: DataFrame, links: DataFrame, as_of: Column
) -> dict[str, DataFrame]:
    """Apply review decisions.

    ``decisions`` has ``candidate_id, action`` (approve or reject) and for an
    approval optionally ``tag_id`` or ``name``.  Without a tag id the tag is
    found by normalised name (a disabled one is enabled again) or created.  Only
    the candidate's own article is linked.  Slugs stay unique: a new name whose slug
    is held by another tag, or claimed by an earlier candidate of the batch under
    another name, is refused and its candidates stay as they are.

    Returns the new ``candidates``, ``vocabulary`` and ``links``, and the
    ``errors`` of decisions that could not be applied.
    """
    asked = decisions.join(candidates.withColumnRenamed("id", "candidate_id"), "candidate_id").select(
        "candidate_id", "action", "tag_id", "article_id", "evaluation_id",
        F.coalesce(F.nullif("name", F.lit("")), F.col("suggested_tag")).alias("wanted"),
    )
    asked = asked.withColumn("normalized_name", normalize_tag(F.col("wanted")))
    approvals = asked.filter(F.col("action") == "approve")
    by_id = approvals.filter(F.col("tag_id").isNotNull())
    by_name = approvals.filter(F.col("tag_id").isNull() & (F.col("normalized_name") != ""))
    ids = vocabulary.select(F.col("id").alias("tag_id"))
    errors = (
        by_id.join(ids, "tag_id", "left_anti")
        .select("candidate_id", F.lit("tag not found").alias("error"))
        .unionByName(
            approvals.filter(F.col("tag_id").isNull() & (F.col("normalized_name") == "")).select(
                "candidate_id", F.lit("tag name must not be empty").alias("error")
            )
        )
    )
    wanted = by_name.groupBy("normalized_name").agg(
        F.min("candidate_id").alias("first_candidate"), F.min_by("wanted", "candidate_id").alias("wanted")
    )
    top_id = vocabulary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    new = (
        wanted.join(vocabulary.select("normalized_name"), "normalized_name", "left_anti")
        .withColumn("slug", tag_slug(F.col("wanted")))
    )
    # names are unique here, so their first candidates are too and match the claims back
    claims = (
        new.groupBy("slug").agg(F.min("first_candidate").alias("first_candidate"))
        .join(vocabulary.select("slug"), "slug", "left_anti").select("first_candidate")
    )
    granted = new.join(claims, "first_candidate", "left_semi")
    refused = by_name.join(new.join(claims, "first_candidate", "left_anti").select("normalized_name"), "normalized_name", "left_semi")
    errors = errors.unionByName(refused.select("candidate_id", F.lit("tag already exists").alias("error")))
    created = numbered(granted, ["first_candidate"], top_id).select(
        "id",
        strip(F.col("wanted")).alias("name"),
        "normalized_name",
        "slug",
        F.lit(DESCRIPTION_APPROVED_TAG).alias("description"),
        F.lit("active").alias("status"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    hit = F.col("first_candidate").isNotNull() & (F.col("status") != "active")
    kept = (
        vocabulary.join(wanted.select("normalized_name", "first_candidate"), "normalized_name", "left")
        .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
        .withColumn("status", F.when(hit, F.lit("active")).otherwise(F.col("status")))
        .select(*_TAG_ROW)
    )
    new_vocabulary = kept.unionByName(created)
    names = new_vocabulary.select("normalized_name", F.col("id").alias("tag_id"))
    approved = (
        by_id.join(ids, "tag_id", "left_semi")
        .select("candidate_id", "article_id", "evaluation_id", "tag_id")
        .unionByName(
            by_name.drop("tag_id").join(names, "normalized_name").select(
                "candidate_id", "article_id", "evaluation_id", "tag_id"
            )
        )
    )
    linked = (
        approved.groupBy("article_id", "tag_id")
        .agg(F.min_by("evaluation_id", "candidate_id").alias("evaluation_id"))
        .withColumn("created_at", as_of)
        .join(links.select("article_id", "tag_id"), ["article_id", "tag_id"], "left_anti")
    )
    outcome = approved.select("candidate_id", F.lit("approved").alias("outcome")).unionByName(
        asked.filter(F.col("action") == "reject").select("candidate_id", F.lit("rejected").alias("outcome"))
    )
    decided = F.col("outcome").isNotNull()
    new_values = {
        "status": F.coalesce("outcome", "status"),
        "reviewed_at": F.when(decided, as_of).otherwise(F.col("reviewed_at")),
        "updated_at": F.when(decided, as_of).otherwise(F.col("updated_at")),
    }
    new_candidates = candidates.join(outcome, candidates.id == outcome.candidate_id, "left").select(
        *[new_values.get(name, F.col(name)).alias(name) for name in candidates.columns]
    )
    columns = ["article_id", "tag_id", "evaluation_id", "created_at"]
    return {
        "candidates": new_candidates,
        "vocabulary": new_vocabulary,
        "links": links.select(*columns).unionByName(linked.select(*columns)),
        "errors": errors,
    }


def change_vocabulary(vocabulary: DataFrame, changes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Create, rename, describe, enable and disable tags.

    ``changes`` has ``ordinal, tag_id, name, description, status``; a row without
    ``tag_id`` creates a tag.  Null fields stay as they are.  Normalised name and
    slug stay unique: a change that would break this is refused and reported,
    the earlier row of a batch winning.  A name that a rename gives up is free
    from the next batch on.  Returns vocabulary and refusals.
    """
    named = changes.withColumns({"new_normalized": normalize_tag(F.col("name")), "new_slug": tag_slug(F.col("name"))})
    creates = F.col("tag_id").isNull()
    empty = (creates & F.col("name").isNull()) | (F.col("new_normalized") == "")
    known = named.join(vocabulary.select(F.col("id").alias("tag_id"), F.lit(True).alias("exists")), "tag_id", "left")
    by_name = vocabulary.select(F.col("normalized_name").alias("new_normalized"), F.col("id").alias("name_owner"))
    by_slug = vocabulary.select(F.col("slug").alias("new_slug"), F.col("id").alias("slug_owner"))

    def taken(owner: str) -> Column:
        return F.col(owner).isNotNull() & ~F.col(owner).eqNullSafe(F.col("tag_id"))

    owned = (
        known.join(by_name, "new_normalized", "left")
        .join(by_slug, "new_slug", "left")
        .withColumn(
            "refusal",
            F.when(~creates & F.col("exists").isNull(), F.lit("tag not found"))
            .when(empty, F.lit("tag name must not be empty"))
            .when(taken("name_owner") | taken("slug_owner"), F.lit("tag already exists")),
        )
    )
    # A slug follows from the normalised name, so the first valid claim of a slug
    # in the batch also settles the name.  Claims match back by unique ordinal.
    claims = (
        owned.filter(F.col("refusal").isNull() & F.col("new_slug").isNotNull())
        .groupBy("new_slug")
        .agg(F.min("ordinal").alias("ordinal"))
        .select("ordinal", F.lit(True).alias("first_claim"))
    )
    late = F.col("new_slug").isNotNull() & F.col("first_claim").isNull()
    judged = owned.join(claims, "ordinal", "left").withColumn(
        "refusal", F.coalesce("refusal", F.when(late, F.lit("tag already exists")))
    )
    refused = judged.filter(F.col("refusal").isNotNull()).select("ordinal", "tag_id", "name", F.col("refusal").alias("error"))
    granted = judged.filter(F.col("refusal").isNull())
    top_id = vocabulary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    created = numbered(granted.filter(creates), ["ordinal"], top_id).select(
        "id",
        strip(F.col("name")).alias("name"),
        F.col("new_normalized").alias("normalized_name"),
        F.col("new_slug").alias("slug"),
        strip(F.coalesce("description", F.lit(""))).alias("description"),
        F.coalesce("status", F.lit("active")).alias("status"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("ordinal")))

    updates = granted.filter(~creates).groupBy("tag_id").agg(
        last(strip(F.col("name"))).alias("u_name"),
        last(F.col("new_normalized")).alias("u_normalized"),
        last(F.col("new_slug")).alias("u_slug"),
        last(strip(F.col("description"))).alias("u_description"),
        last(F.col("status")).alias("u_status"),
    )
    touched = F.coalesce("u_name", "u_description", "u_status").isNotNull()
    v = vocabulary.withColumnRenamed("id", "tag_id").join(updates, "tag_id", "left")
    kept = v.select(
        F.col("tag_id").alias("id"),
        F.coalesce("u_name", "name").alias("name"),
        F.coalesce("u_normalized", "normalized_name").alias("normalized_name"),
        F.coalesce("u_slug", "slug").alias("slug"),
        F.coalesce("u_description", "description").alias("description"),
        F.coalesce("u_status", "status").alias("status"),
        "created_at",
        F.when(touched, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return kept.unionByName(created), refused


def bootstrap_vocabulary(evaluations: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary rows and links from the tags of past verdicts.

    Names compare by ``lower(trim)`` only; inner spaces are not collapsed here.
    A tag whose name or slug is taken already adds no row.  Returns the rows to
    add (ids from ``max(id) + 1`` on in order of first use) and the links.
    """
    used = evaluations.select(
        F.col("id").alias("evaluation_id"), "article_id", "evaluated_at", F.posexplode("tags").alias("at", "raw")
    ).select(
        "evaluation_id", "article_id", "evaluated_at", "at", F.trim("raw").alias("name"),
        F.lower(F.trim("raw")).alias("normalized_name"),
    ).filter(F.col("name") != "")
    slug = F.replace(F.lower("name"), F.lit(" "), F.lit("-"))
    order = F.struct("evaluation_id", "at")
    first = (
        used.withColumn("slug", slug)
        .groupBy("slug")
        .agg(F.min_by(F.struct("name", "normalized_name", "evaluated_at"), order).alias("f"), F.min(order).alias("first_use"))
    )
    top_id = vocabulary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    added = (
        first.select("slug", "first_use.*", "f.*")
        .join(vocabulary.select("normalized_name"), "normalized_name", "left_anti")
        .join(vocabulary.select("slug"), "slug", "left_anti")
    )
    rows = numbered(added, ["evaluation_id", "at"], top_id).select(
        "id", "name", "normalized_name", "slug",
        F.lit(DESCRIPTION_BOOTSTRAP_TAG).alias("description"),
        F.lit("active").alias("status"),
        F.col("evaluated_at").alias("created_at"),
        F.col("evaluated_at").alias("updated_at"),
    )
    names = vocabulary.select("normalized_name", F.col("id").alias("tag_id")).unionByName(
        rows.select("normalized_name", F.col("id").alias("tag_id"))
    )
    links = (
        used.join(names, "normalized_name")
        .groupBy("article_id", "tag_id")
        .agg(F.min_by(F.struct("evaluation_id", "evaluated_at"), "evaluation_id").alias("f"))
        .select("article_id", "tag_id", "f.evaluation_id", F.col("f.evaluated_at").alias("created_at"))
    )
    return rows, links
