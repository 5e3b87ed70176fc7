"""Functions that the SQL engine lacks: tails of the normal distribution, as Arrow-batched UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def upper_tail(z: float | None) -> float | None:
    return None if z is None or z != z else 0.5 * math.erfc(z / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def normal_upper_tail(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2.0)), na_action="ignore")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| > |z|)."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2.0)), na_action="ignore")
