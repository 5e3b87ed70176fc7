"""Column expressions with the semantics of the metrics: NULL is missing, no infinities, guarded frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def safe_div(a: Column, b: Column) -> Column:
    """NULL where the denominator is 0 or missing."""
    return F.try_divide(a, b)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b); NULL where either is missing or not above 0 (a price of 0 has no return)."""
    return F.when((a > 0) & (b > 0), F.ln(F.try_divide(a, b)))


def pos_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def clip(x: Column, low=None, high=None) -> Column:
    """Missing stays missing, unlike bare least and greatest."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def rolling(agg: Column, x: Column, order: WindowSpec, n: int, least: int | None = None, skip: int = 0) -> Column:
    """``agg`` over the ``n`` rows that end ``skip`` rows before this one; NULL below ``least`` values."""
    frame = order.rowsBetween(-(n - 1) - skip, -skip)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg.over(frame))


def order_by(*columns: str, by: tuple[str, ...] = ()) -> WindowSpec:
    """A total order; without ``by`` only for tables of bars, which are small."""
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*columns)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bucketed_last(df: DataFrame, values: dict[str, Column], order: list[str], bucket: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each name, the last non-NULL value strictly before a row in ``order``.

    Buckets (an ascending column that the order respects) are worked on in parallel; the value that
    enters a bucket comes from a window over one row for each bucket.
    """
    keys = [*by, bucket]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # a value may itself be NULL inside its row, so that it travels in a struct
    wrapped = {k: F.when(v.isNotNull(), F.struct(v.alias("v"))) for k, v in values.items()}
    held = df.withColumns({f"_v_{k}": v for k, v in wrapped.items()})
    ends = held.groupBy(*keys).agg(*(F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.struct(*order))).alias(f"_l_{k}") for k in values))
    enters = ends.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.last(f"_l_{k}", ignorenulls=True).over(before).alias(f"_e_{k}") for k in values))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    inside = held.withColumns({f"_w_{k}": F.last(f"_v_{k}", ignorenulls=True).over(within) for k in values})
    joined = inside.join(enters, same, "left")
    return joined.select(*df.columns, *(F.coalesce(f"_w_{k}", f"_e_{k}")["v"].alias(k) for k in values))
