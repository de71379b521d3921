"""Small literal frames for tests."""

from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner import schemas


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc) if text else None


def frame(spark, ddl, *rows):
    """Rows as dicts; missing columns are null and times are ISO text."""
    schema = StructType.fromDDL(ddl)
    values = []
    for row in rows:
        unknown = set(row) - set(schema.names)
        assert not unknown, unknown
        values.append(
            tuple(
                at(row[f.name]) if f.dataType.typeName() == "timestamp" and isinstance(row.get(f.name), str) else row.get(f.name)
                for f in schema.fields
            )
        )
    return spark.createDataFrame(values, schema)


def article(id, **fields):
    base = dict(
        id=id, source_name="s", title=f"T{id}", url=f"https://e.com/{id}", normalized_url=f"https://e.com/{id}", slug=f"s-t{id}",
        status="candidate", retry_count=0, created_at="2026-01-01T00:00:00", updated_at="2026-01-01T00:00:00", source_tags=[],
    )
    return {**base, **fields}


def articles(spark, *rows):
    return frame(spark, schemas.ARTICLES, *rows)


def fetches(spark, *rows):
    return frame(spark, schemas.FETCHES, *[{"fetched_at": "2026-02-01T00:00:00", "status": "success", **r} for r in rows])


def evaluations(spark, *rows):
    base = dict(
        evaluated_at="2026-02-02T00:00:00", decision="accept", content_type="tooling_note", summary="S", tags=["AI"],
        suggested_tags=[], recommendation_reason="R", model_name="m",
    )
    return frame(spark, schemas.EVALUATIONS, *[{**base, **r} for r in rows])


def failures(spark, *rows):
    return frame(spark, schemas.EVALUATION_FAILURES, *[{"failed_at": "2026-02-03T00:00:00", "error": "bad", "attempts": 3, **r} for r in rows])


def entries(spark, *rows):
    return frame(spark, schemas.ENTRIES, *[{"source_name": "s", "ordinal": i, "source_tags": [], **r} for i, r in enumerate(rows)])


def vocabulary(spark, *names):
    rows = []
    for i, name in enumerate(names, 1):
        disabled = name.startswith("-")
        name = name.lstrip("-")
        rows.append(dict(id=i, name=name, normalized_name=name.lower(), slug=name.lower().replace(" ", "-"), description="",
                         status="disabled" if disabled else "active", created_at="2026-01-01T00:00:00", updated_at="2026-01-01T00:00:00"))
    return frame(spark, schemas.VOCABULARY, *rows)


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def moment(text="2026-03-01T00:00:00"):
    return F.lit(text).cast("timestamp")


def shown(value):
    return value.isoformat() if value else None
