"""Windows over rows in order without a single task: ranges of rows, each with a halo, and running sums in two levels.

``in_ranges`` numbers the rows of each key, deals them to tasks by ranges of ``rows`` of them, copies in the rows
that a frame reaches beyond its range (the halo), and lets the caller's windows run inside each range.  Only the
range's own rows come out.  A hot key is so dealt to as many tasks as it has ranges.

Numbers come from two levels (rows of each cell, a sum over the cells), or from ``index`` where rows have no gaps.
A cell is a day of timestamps, a month of dates, 1,024 of whole numbers; only a row for each cell of a key meets in
one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ROWS = 1 << 16
#: Columns that this module adds and takes away.
CELL, ROW, RANGE, OWN = "_cell", "_row", "_range", "_own"


def cell_of(df: DataFrame, order: str) -> Column:
    """Coarser steps of the order, which it respects."""
    kind = df.schema[order].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.date_trunc("day", order)
    if kind == "date":
        return F.trunc(order, "month")
    if kind in ("long", "integer", "short", "byte"):
        return F.floor(F.col(order) / 1024)
    raise ValueError(f"no cells for a column of type {kind}")


def _same(keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys))


def carried(celled: DataFrame, by: tuple[str, ...], sums: dict[str, Column], over: Callable = F.sum) -> DataFrame:
    """Adds, for each name, what ``sums`` come to (under ``over``) in all cells of the key before a row's own."""
    keys = (*by, CELL)
    before = Window.partitionBy(*(by or (F.lit(0),))).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy(*keys).agg(*(v.alias(k) for k, v in sums.items()))
    starts = cells.select(*(F.col(k).alias(f"_k{k}") for k in keys), *(over(k).over(before).alias(k) for k in sums))
    return celled.join(starts, _same(keys), "left").drop(*(f"_k{k}" for k in keys))


def numbered(df: DataFrame, order: list[str], by: tuple[str, ...] = (), name: str = ROW) -> DataFrame:
    """Adds the number of each row of its key, from 0."""
    celled = df.withColumn(CELL, cell_of(df, order[0]))
    told = carried(celled, by, {"_before": F.count(F.lit(1))})
    inside = F.row_number().over(Window.partitionBy(*by, CELL).orderBy(*order))
    return told.withColumn(name, F.coalesce("_before", F.lit(0)) + inside - 1).drop("_before", CELL)


def in_ranges(
    df: DataFrame,
    order: list[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int,
    after: int = 0,
    by: tuple[str, ...] = (),
    rows: int = ROWS,
    index: Column | None = None,
) -> DataFrame:
    """What ``compute(rows, window)`` makes of each key's rows in order; its frames reach ``before`` rows back and ``after`` ahead.

    ``compute`` adds columns to the rows and keeps those it is given; a column that another window reads needs
    the reach of both.
    """
    told = numbered(df, order, by) if index is None else df.withColumn(ROW, index)
    size = max(rows, before + after, 1)
    own, at = F.floor(F.col(ROW) / size), F.col(ROW)
    # each row stands in its own range and in those whose frames reach it
    reached = F.sequence(F.floor((at - after) / size), F.floor((at + before) / size))
    dealt = told.withColumn(RANGE, F.explode(reached)).withColumn(OWN, F.col(RANGE) == own)
    made = compute(dealt, Window.partitionBy(*by, RANGE).orderBy(ROW))
    return made.where(OWN).drop(ROW, RANGE, OWN)


def running(df: DataFrame, x: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``cum``, the running sum of ``x`` within its key, and ``peak``, the highest ``cum`` so far."""
    celled = df.withColumn(CELL, cell_of(df, order[0]))
    upto = Window.partitionBy(*by, CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = carried(celled, by, {"_sum": F.sum(x)}).withColumn("cum", F.coalesce("_sum", F.lit(0.0)) + F.coalesce(F.sum(x).over(upto), F.lit(0.0)))
    told = carried(told, by, {"_peak": F.max("cum")}, F.max)
    return told.withColumn("peak", F.greatest("_peak", F.max("cum").over(upto))).drop("_sum", "_peak", CELL)


def ewm_mean(df: DataFrame, x: str, order: list[str], span: float, name: str, by: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Adds the exponentially weighted mean of ``x`` up to each row: weights (1 - 2 / (span + 1)) to the rows' distance, adjusted.

    A missing value has no weight but keeps its place.  Rows so far back that their weight is lost in a double
    (a part of 10^18) are not looked at.
    """
    decay = 1 - 2 / (span + 1)
    reach = max(1, math.ceil(math.log(1e-18) / math.log(decay))) if decay > 0 else 1

    def weighted(told: DataFrame, w: WindowSpec) -> DataFrame:
        near = F.collect_list(F.struct(F.col(ROW).alias("at"), F.col(x).alias("v"))).over(w.rowsBetween(-reach, 0))
        weigh = lambda r: F.when(r["v"].isNotNull(), F.pow(F.lit(decay), F.col(ROW) - r["at"])).otherwise(0.0)
        total = lambda part: F.aggregate("_near", F.lit(0.0), lambda a, r: a + part(r))
        mean = F.try_divide(total(lambda r: weigh(r) * F.coalesce(r["v"], F.lit(0.0))), total(weigh))
        return told.withColumn("_near", near).withColumn(name, mean).drop("_near")

    return in_ranges(df, order, weighted, reach, 0, by, rows)
