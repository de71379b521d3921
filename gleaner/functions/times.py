"""Time expressions.  All need ``spark.sql.session.timeZone=UTC``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.constants import MONTHS, ZONE_OFFSETS
from gleaner.functions.text import strip

# The usual spelling, which Spark's own cast reads.
_PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"
# ISO-8601 in the extended or the basic form, one arbitrary separator character.
_ISO = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:\D(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,]\d+)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    "sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
# RFC 2822 dates as mail and feed software writes them.
_RFC = (
    r"(?i)^(?:[a-z]+,?\s+|[a-z]+,)?(\d{1,2})[\s-]+(" + _MONTH + r")[\s-]+(\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([+-]\d{4}|[a-z]+))?(?:\s.*)?$"
)

# A date by year, ISO week and weekday (Monday if left out), with what follows it.
_WEEK = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?(?=$|\D)(.*)$"


def iso_z(ts: Column) -> Column:
    """Render a timestamp as ``YYYY-MM-DDTHH:MM:SSZ``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def http_date(ts: Column) -> Column:
    """Render a timestamp the way HTTP and RSS headers do."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def _part(text: Column, pattern: str, group: int, default: str) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found == "", F.lit(default)).otherwise(found)


def _from_iso(text: Column) -> Column:
    stamp = F.concat(
        F.regexp_extract(text, _ISO, 1), F.lit("-"),
        F.regexp_extract(text, _ISO, 3), F.lit("-"),
        F.regexp_extract(text, _ISO, 4), F.lit(" "),
        _part(text, _ISO, 5, "00"), F.lit(":"),
        _part(text, _ISO, 7, "00"), F.lit(":"),
        _part(text, _ISO, 8, "00"),
        _part(text, _ISO, 9, "Z"),
    )
    return F.try_to_timestamp(stamp)


def _from_week(text: Column) -> Column:
    """The text with a week date written as a calendar date; null if it has none.

    The week holds the Thursday that belongs to its year, which also tells whether
    the year has that week.
    """
    year, week = (F.regexp_extract(text, _WEEK, group).try_cast("int") for group in (1, 3))
    monday = F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (week - 1) * 7)
    thursday = F.date_add(monday, 3)
    day = F.date_add(monday, _part(text, _WEEK, 4, "1").cast("int") - 1)
    exists = (F.year(thursday) == year) & (F.weekofyear(thursday) == week)
    return F.when(exists, F.concat(F.date_format(day, "yyyy-MM-dd"), F.regexp_extract(text, _WEEK, 5)))


def _from_rfc(text: Column) -> Column:
    month = (F.position(F.lower(F.left(F.regexp_extract(text, _RFC, 2), F.lit(3))), F.lit(MONTHS)) + 2) / 3
    year = F.regexp_extract(text, _RFC, 3)
    zone = F.upper(F.regexp_extract(text, _RFC, 7))
    offset = F.when(zone.rlike(r"^[+-]\d{4}$"), zone)
    for name, value in ZONE_OFFSETS.items():
        offset = offset.when(zone == name, F.lit(value))
    stamp = F.concat(
        F.when(F.length(year) == 4, year).when(year <= "68", F.concat(F.lit("20"), year))
        .otherwise(F.concat(F.lit("19"), year)),
        F.lit("-"), F.lpad(month.cast("int").cast("string"), 2, "0"),
        F.lit("-"), F.lpad(F.regexp_extract(text, _RFC, 1), 2, "0"),
        F.lit(" "), F.lpad(F.regexp_extract(text, _RFC, 4), 2, "0"),
        F.lit(":"), F.regexp_extract(text, _RFC, 5),
        F.lit(":"), _part(text, _RFC, 6, "00"),
        offset.otherwise(F.lit("Z")),
    )
    return F.try_to_timestamp(stamp)


def parse_datetime(value: Column, date_as_end: bool = False) -> Column:
    """ISO date (also by week), ISO date-time (naive = UTC) or RFC 2822 to a timestamp; else null.

    A plain date means its midnight, or with ``date_as_end`` the next midnight.
    Fractions of a second are cut off.
    """
    text = strip(value)

    def of_iso(text: Column) -> Column:
        day = F.try_to_timestamp(F.concat(text, F.lit(" 00:00:00Z")))
        if date_as_end:
            day = day + F.expr("INTERVAL 1 DAY")
        return (
            F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)
            .when(text.rlike(_PLAIN), F.date_trunc("second", F.try_to_timestamp(text)))
            .when(text.rlike(_ISO), _from_iso(text))
        )

    # few texts are week dates: their calendar form is bound once and parsed apart from the common ones
    week = F.get(F.transform(F.array(_from_week(text)), of_iso), F.lit(0))
    return (
        F.when(F.substring(text, 5, 2).contains("W") & text.rlike(_WEEK), week)
        .when(text.rlike(_RFC), _from_rfc(text))
        .otherwise(of_iso(text))
    )


def first_time(values: Column) -> Column:
    """First parseable time of an array of strings."""
    return F.try_element_at(
        F.filter(F.transform(values, lambda v: parse_datetime(v)), lambda t: t.isNotNull()), F.lit(1)
    )


def build_time_range(
    since: str | None = None,
    until: str | None = None,
    since_days: int | None = None,
    as_of: str | None = None,
) -> tuple[Column | None, Column | None]:
    """Window bounds as constant columns (folded by Catalyst, so they push down)."""
    lower = parse_datetime(F.lit(since)) if since else None
    if since_days is not None:
        if as_of is None:
            raise ValueError("since_days needs as_of")
        default = F.date_trunc("second", parse_datetime(F.lit(as_of)) - F.make_interval(days=F.lit(since_days)))
        lower = default if lower is None else F.coalesce(lower, default)
    upper = parse_datetime(F.lit(until), date_as_end=True) if until else None
    return lower, upper


def in_range(ts: Column, since: Column | None, until: Column | None) -> Column:
    """Half-open window test; an unknown time (or an unparseable bound) passes."""
    inside = F.lit(True)
    if since is not None:
        inside = inside & F.coalesce(ts >= since, F.lit(True))
    if until is not None:
        inside = inside & F.coalesce(ts < until, F.lit(True))
    return inside


def item_time(prefix: str = "") -> Column:
    """First known time of an article: published, collected, updated, created."""
    names = ("published_at", "collected_at", "updated_at", "created_at")
    return F.coalesce(*[F.col(f"{prefix}{name}") for name in names])
