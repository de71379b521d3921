"""Secret scans with multipart linking, in DataFrame functions only.

Base kinds are reported wherever they stand.  Weak kinds (an unlabelled key, an
account name, an endpoint) are reported only when the parts that complete them
stand in the same scope, that is at most ``scope`` code points away in the same
text: a key needs an identifier, an account a secret, an endpoint both.
Identifiers are access ids and accounts; secrets are assignments, hex runs and keys.

Places come from the lengths of matches and of the text between them, summed over
the matches of a text.  The interval join cuts texts into cells of ``scope + 1`` code
points, so that parts at a distance of ``scope`` lie in neighbouring cells at most.  Of the parts of a role in a cell only the first start and the last end
are needed: a weak part meets all of its own cells, and in the neighbouring ones
the nearest part decides.  So no pairs are made, however many parts a text has.

A null text counts as empty.  Rows that agree in id and text are one document.
Extra columns are not carried.  Places are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import written

SCOPE = 300


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: tuple[str, ...] = ()  # roles that must stand in scope
    role: str | None = None


# The patterns of the base kinds; the others follow their style.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    Kind("assign", ASSIGN, role="secret"),
    Kind("access", r"AKIA[A-Z0-9]+", role="identifier"),
    Kind("hex", r"[0-9a-f]{24,}", role="secret"),
    Kind("key", r"[A-Za-z0-9/+]{40,}", needs=("identifier",), role="secret"),
    Kind("account", r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]+""", needs=("secret",), role="identifier"),
    Kind("endpoint", r"""https?://[^\x00-\x20"'<>]+""", needs=("identifier", "secret")),
]
BASE = 3
# what a text must hold to be looked at; accounts and endpoints never stand alone
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9/+]{40}"""


def _valid(kind: Column, match: Column) -> Column:
    size = F.length(match)
    return (
        F.when(kind == 0, F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6)
        .when(kind == 1, size >= 20)
        .when(kind == 3, (size == 40) & ~match.rlike("^[0-9a-f]+$"))
        .otherwise(True)
    )


def parts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All candidates: doc_id, text_hash, kind (its place in KINDS), start, end, match."""
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")).filter(text.rlike(_ANY))
    found = [
        F.struct(F.lit(i).alias("kind"), F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"))
        for i, kind in enumerate(KINDS)
    ]
    by_kind = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(*found)).alias("found")
    ).select("doc_id", "text_hash", "row", "found.*").filter(F.size("matches") > 0)
    step = F.transform(
        "matches", lambda match, i: F.struct(F.length(F.get("gaps", i)).alias("gap"), match.alias("match"))
    )
    steps = by_kind.select("doc_id", "text_hash", "row", "kind", F.posexplode(step).alias("place", "step"))
    so_far = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    match = F.col("step.match")
    ended = steps.withColumn("end", F.sum(F.col("step.gap") + F.length(match)).over(so_far))
    return ended.filter(_valid(F.col("kind"), match)).select(
        "doc_id", "text_hash", "kind", (F.col("end") - F.length(match)).alias("start"), "end", match.alias("match")
    ).distinct()


def linked(candidates: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates whose complementary parts stand in scope."""
    key = ["doc_id", "text_hash"]
    of_kind = {role: [i for i, kind in enumerate(KINDS) if kind.role == role] for role in ("identifier", "secret")}
    cell = lambda place: F.floor(place / (scope + 1))
    last = F.greatest(F.col("end") - 1, F.col("start"))
    roles = F.when(F.col("kind").isin(of_kind["identifier"]), F.lit("identifier")).when(F.col("kind").isin(of_kind["secret"]), F.lit("secret"))
    present = (
        candidates.withColumn("role", roles).filter("role IS NOT NULL")
        .withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(last))))
        .groupBy(*key, "role", "cell").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end")).alias("p")
    )
    needs = F.create_map(*[x for i, kind in enumerate(KINDS) if kind.needs for x in (F.lit(i), F.array(*map(F.lit, kind.needs)))])
    weak = candidates.filter(F.col("kind") >= BASE).withColumn("needed", F.element_at(needs, F.col("kind")))
    own = (cell(F.col("start")), cell(last))
    looked = weak.withColumn("role", F.explode("needed")).withColumn("cell", F.explode(F.sequence(own[0] - 1, own[1] + 1))).alias("w")
    same = [F.col(f"w.{name}").eqNullSafe(F.col(f"p.{name}")) for name in [*key, "role", "cell"]]
    near = (
        F.when(F.col("w.cell") < own[0], F.col("w.start") - F.col("p.last_end") <= scope)
        .when(F.col("w.cell") > own[1], F.col("p.first_start") - F.col("w.end") <= scope)
        .otherwise(True)
    )
    span = [*key, "kind", "start", "end"]
    return (
        looked.join(present, same).filter(near).groupBy(*[F.col(f"w.{name}").alias(name) for name in span], F.size("w.needed").alias("asked"))
        .agg(F.count_distinct("w.role").alias("met")).filter("met = asked").select(*span)
    )


def scan(docs: DataFrame, scope: int = SCOPE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The spans that are reported: doc_id, text_hash, kind, start, end."""
    candidates = written(parts(docs, id_column, text_column).drop("match"), "secret-parts")
    base = candidates.filter(F.col("kind") < BASE)
    return base.unionByName(linked(candidates, scope))


def digests(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds and the spans as text."""
    key = ["doc_id", "text_hash"]
    listed = spans.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("spans"))
    names = F.array(*[F.lit(kind.name) for kind in KINDS])

    def joined(chosen: Column) -> Column:
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.coalesce(F.size(F.filter("s.spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")

    base = F.filter("s.spans", lambda s: s["kind"] < BASE)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_column}`")).alias("text_hash")).alias("d")
    same = [F.col(f"d.{name}").eqNullSafe(F.col(f"s.{name}")) for name in key]
    return rows.join(listed.alias("s"), same, "left").select(
        "d.doc_id", *[F.when(F.col("s.spans").isNull(), 0).otherwise(count(i)).cast("long").alias(f"n_{KINDS[i].name}") for i in range(BASE)],
        F.sha2(F.coalesce(joined(base), F.lit("")), 256).alias("base_sha256"), F.coalesce(joined(F.col("s.spans")), F.lit("")).alias("spans"),
    )
