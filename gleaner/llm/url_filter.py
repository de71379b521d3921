"""URL filters: a temporal join of captures with dated filter lists.

A list entry is a dated change: (list_name, kind, value, action, effective_at) with
action ``add`` or ``remove`` and kind ``url`` (a whole address), ``prefix`` (scheme
free host and path up to a slash), ``host`` or ``domain`` (a host and all below it).
The changes of an entry become validity intervals [valid_from, valid_to): it is
active from an ``add`` until the next ``remove``.  Every capture is judged by the
entries active at its fetch time.

A capture is looked up under few keys: its address, the directories of its path,
its host and the domains above it, so the join is an equality on (kind, value) and
a period.  Periods of ``period_days`` cut intervals short, so that a capture meets
only what is active near its time, and one popular host's captures are spread over
the periods.  Captures of one address and instant are looked up once.

Null addresses and fetch times match nothing.  Changes with nulls are left out.  Of
several changes of one entry at one instant ``remove`` counts.  Repeated captures
are all answered; extra columns are carried, and columns of the results' names
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import own_name

PERIOD_DAYS = 30
KINDS = ("domain", "host", "prefix", "url")  # from wide to narrow


def address(url: Column) -> Column:
    """Host (lower case, without port and user) and path with query of an http address."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^(?i:https?)://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(plain, r"^(?i:https?)://[^/?#]+([/?].*)?$", 1)
    path = F.when(path == "", "/").when(path.startswith("?"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.when(host != "", F.struct(host.alias("host"), path.alias("path")))


def keys(parts: Column) -> Column:
    """All (kind, value) under which an address can be listed."""
    host, path = parts["host"], parts["path"]
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.split(F.regexp_extract(path, r"^([^?]*/)", 1), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(folders) - 1), lambda i: F.concat(host, F.array_join(F.slice(folders, 1, i), "/"), F.lit("/"))
    )

    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    return F.concat(of("domain", domains), of("host", F.array(host)), of("prefix", prefixes), of("url", F.array(F.concat(host, path))))


def intervals(changes: DataFrame) -> DataFrame:
    """(list_name, kind, value, valid_from, valid_to); an open end is null."""
    entry = ["list_name", "kind", "value"]
    known = changes.select(*entry, "action", "effective_at").dropna().filter(F.col("action").isin("add", "remove"))
    # one state per instant, then only the instants at which it changes
    states = known.groupBy(*entry, "effective_at").agg(F.min(F.col("action") == "add").alias("active"))
    order = Window.partitionBy(*entry).orderBy("effective_at")
    turns = states.withColumn("was", F.coalesce(F.lag("active").over(order), F.lit(False))).filter("active != was")
    return (
        turns.withColumn("valid_to", F.lead("effective_at").over(order)).filter("active")
        .select(*entry, F.col("effective_at").alias("valid_from"), "valid_to")
    )


def judge(
    captures: DataFrame, changes: DataFrame, url_column: str = "url", time_column: str = "fetched_at", period_days: int = PERIOD_DAYS,
) -> DataFrame:
    """``captures`` with ``blocked``, ``n_entries`` (active entries that match) and ``lists`` (their names, joined by commas)."""
    captures = captures.drop("blocked", "n_entries", "lists")
    found, time = own_name(captures, "parts"), F.col(f"`{time_column}`")
    parsed = captures.withColumn(found, address(F.col(f"`{url_column}`")))

    def period(at: Column) -> Column:
        return F.floor(F.unix_date(at.cast("date")) / period_days)

    # a look-up per address and instant, not per capture
    asked = parsed.filter(F.col(found).isNotNull() & time.isNotNull()).select(F.col(found).alias("parts"), time.alias("at")).distinct()
    wanted = asked.withColumn("key", F.explode(F.array_distinct(keys(F.col("parts"))))).select(
        "parts", "at", F.col("key.kind").alias("kind"), F.col("key.value").alias("value"), period(F.col("at")).alias("period")
    )
    # intervals are cut to the time that captures span before they are dealt to periods
    first, last = (F.lit(bound) for bound in captures.agg(F.min(time), F.max(time)).first())
    dealt = (
        intervals(changes)
        .filter((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
        .withColumn("period", F.explode(F.sequence(
            period(F.greatest(F.col("valid_from"), first)), period(F.least(F.coalesce(F.col("valid_to"), last), last))
        )))
    )
    active = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    matched = (
        wanted.join(dealt, ["kind", "value", "period"]).filter(active)
        .groupBy("parts", "at").agg(F.count(F.lit(1)).alias("n_entries"), F.array_sort(F.collect_set("list_name")).alias("names"))
        .select(F.col("parts").alias("m_parts"), F.col("at").alias("m_at"), "n_entries", "names")
    )
    answers = parsed.join(matched, (F.col(found) == F.col("m_parts")) & (time == F.col("m_at")), "left")
    return answers.select(
        *[F.col(f"`{name}`") for name in captures.columns], F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("lists"),
    )
