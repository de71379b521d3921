"""Pages by cursor: what follows the last row of the page before.

An offset makes Spark order and pass over all rows before a page; a cursor is a
filter that reaches the scan, so every page costs one page.  An order is a list of
(column, ascending) that is unique as a whole; like Spark's, it has nulls first when
ascending and last when descending.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[tuple[str, bool]]


def ordering(order: Order) -> list[Column]:
    return [F.asc(name) if ascending else F.desc(name) for name, ascending in order]


def _beyond(name: str, ascending: bool, value: object) -> Column:
    column = F.col(name)
    if ascending:
        return column.isNotNull() if value is None else column > F.lit(value)
    return F.lit(False) if value is None else (column < F.lit(value)) | column.isNull()


def after(order: Order, cursor: Mapping[str, object]) -> Column:
    """Whether a row comes after the one with the cursor's values."""
    cases = []
    for place, (name, ascending) in enumerate(order):
        same = [F.col(before).eqNullSafe(F.lit(cursor[before])) for before, _ in order[:place]]
        cases.append(functools.reduce(operator.and_, [*same, _beyond(name, ascending, cursor[name])]))
    first, ascending = order[0]
    value = cursor[first]
    if value is not None:
        # implied by the cases, and simple enough to reach the scan
        bound = F.col(first) >= F.lit(value) if ascending else (F.col(first) <= F.lit(value)) | F.col(first).isNull()
        return bound & functools.reduce(operator.or_, cases)
    return functools.reduce(operator.or_, cases)


def cursor_page(frame: DataFrame, order: Order, page_size: int, cursor: Mapping[str, object] | None = None) -> DataFrame:
    """The first rows after the cursor; without one the first of all."""
    rows = frame.filter(after(order, cursor)) if cursor else frame
    return rows.orderBy(*ordering(order)).limit(max(1, page_size))


def cursor_of(page: DataFrame, order: Order) -> dict[str, object] | None:
    """The cursor behind a page (of bounded size); nothing if the page is empty."""
    back = [F.desc(name) if ascending else F.asc(name) for name, ascending in order]
    last = page.select(*[name for name, _ in order]).orderBy(*back).first()
    return last and last.asDict()


def cursor_envelope(items: DataFrame, filtered: DataFrame, order: Order) -> DataFrame:
    """A page's items in order, the total of all pages and the cursor of the next one (null on an empty page), in one row.

    A page is bounded by its size, so it is numbered in one place.
    """
    total = filtered.agg(F.count(F.lit(1)).alias("total")).scalar()
    numbered = items.withColumn("_place", F.row_number().over(Window.orderBy(*ordering(order))))
    rows = numbered.agg(F.array_sort(F.collect_list(F.struct("_place", F.struct(*items.columns).alias("item")))).alias("rows"))
    listed = rows.select(F.transform("rows", lambda row: row["item"]).alias("items"), total.alias("total"))
    last = F.get("items", F.size("items") - 1)
    return listed.select(
        "items", "total", F.when(F.size("items") > 0, F.struct(*[last[name].alias(name) for name, _ in order])).alias("cursor")
    )
