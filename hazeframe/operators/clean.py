"""Cleaning operators: null/range predicates (P4-P6), gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.functions.scalars import VALID_MAX, VALID_MIN, finite_or_null
from hazeframe.operators.sequence import DEFAULT_CHUNK_ROWS, RN, carry_nonnull, materialize
from hazeframe.operators.stats import key_medians

INTERP_LIMIT = 3
FFILL_LIMIT = 24


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``subset``."""
    return df.na.drop(subset=list(subset))


def range_filter(df: DataFrame, col: str, lo: float | None = VALID_MIN, hi: float | None = VALID_MAX) -> DataFrame:
    """P5: keep ``lo <= col <= hi`` (either bound optional); NULL never passes."""
    c = F.col(col)
    cond = c.isNotNull()
    if lo is not None:
        cond = cond & (c >= lo)
    if hi is not None:
        cond = cond & (c <= hi)
    return df.where(cond)


def nonfinite_to_null(df: DataFrame, col: str) -> DataFrame:
    """NaN / +-inf -> NULL."""
    return df.withColumn(col, finite_or_null(col))


def fill_gaps(df: DataFrame, keys, value: str, rn_col: str = RN, interp_limit: int = INTERP_LIMIT,
              ffill_limit: int = FFILL_LIMIT, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W1 + W2 on a row-indexed frame: linear interpolation by position for the first
    ``interp_limit`` missing rows after an observation, then forward fill of the last filled value
    for ``ffill_limit`` more rows. Leading gaps stay NULL; trailing gaps take the last value.

    With ``k`` = distance to the previous observation: value = prev + (next - prev) *
    least(k, interp_limit) / (gap span), or prev when no later observation exists; NULL when
    ``k > interp_limit + ffill_limit`` or there is no earlier observation.
    """
    d = carry_nonnull(df, keys, value, rn_col=rn_col, size=chunk_rows)
    v, k = F.col(value), F.col(rn_col) - F.col("_pi")
    span = F.col("_ni") - F.col("_pi")
    interp = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * F.least(k, F.lit(interp_limit)) / span
    filled = (F.when(v.isNotNull(), v)
               .when(F.col("_pi").isNull() | (k > interp_limit + ffill_limit), F.lit(None).cast("double"))
               .when(F.col("_nv").isNull(), F.col("_pv"))
               .otherwise(interp))
    return d.withColumn(value, filled).drop("_pv", "_pi", "_nv", "_ni")


def fill_with_key_median(df: DataFrame, keys, value: str) -> DataFrame:
    """Remaining NULLs take the median of the key (median of the already filled series)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    med = materialize(key_medians(df, keys, [value], ["_kmed"]))  # one row per key
    return (df.join(med, keys, "left")
              .withColumn(value, F.coalesce(F.col(value), F.col("_kmed")))
              .drop("_kmed"))
