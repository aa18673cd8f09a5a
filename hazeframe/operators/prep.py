"""Model input preparation.

Fitted statistics (medians, means, population stds) are one-row tables joined with a broadcast
of that single row; no feature row ever goes to the driver. The only driver value is the list of
one-hot levels of the key column, which names the output columns (as many as the key has values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.operators.sequence import index_rows
from hazeframe.operators.stats import key_medians

# The feature lists of the three models.
FORECAST_FEATURES = ["hour", "day_of_week", "month", "is_weekend", "pm25_lag_1h", "pm25_lag_24h",
                     "pm25_rolling_mean_24h", "pm25_rolling_std_24h"]
CLUSTER_FEATURES = ["pm25", "hour", "day_of_week", "month"]
ANOMALY_FEATURES = ["pm25", "hour", "day_of_week", "month", "pm25_rolling_mean_24h"]
SEED = 42


def onehot_levels(df: DataFrame, col: str) -> list[str]:
    """The column's distinct values in order: the names of the output columns."""
    return [r[0] for r in df.select(col).distinct().where(F.col(col).isNotNull()).orderBy(col).collect()]


def onehot(df: DataFrame, col: str, prefix: str | None = None, levels: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """M1: one 0/1 int column per level (alphabetical, all levels kept), named ``prefix_level``."""
    prefix = prefix or col
    levels = list(levels) if levels is not None else onehot_levels(df, col)
    names = [f"{prefix}_{lv}" for lv in levels]
    d = df.select("*", *[(F.col(col) == lv).cast("int").alias(n) for lv, n in zip(levels, names)])
    return d, names


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M2: NULLs in each column take the column's median over the whole table. One pass counts the NULLs; only
    columns that have some are ranked."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else []  # one row
    cols = [c for c, n in zip(cols, nulls) if n]
    if not cols:
        return df
    med = key_medians(df, None, cols, [f"_m{i}" for i in range(len(cols))])
    d = df.crossJoin(F.broadcast(med))  # one row
    idx = {c: i for i, c in enumerate(cols)}
    return d.select(*[F.coalesce(F.col(c), F.col(f"_m{idx[c]}")).alias(c) if c in idx else F.col(c)
                      for c in df.columns])


def scaler_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M3 fit: one row with mean and population std of every column."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"_mu{i}"), F.stddev_pop(c).alias(f"_sd{i}")]
    return df.agg(*aggs)


def scaler_apply(df: DataFrame, model: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """M3 transform: (x - mean) / std; a zero std scales by 1 (as the fitted scaler does)."""
    cols = list(cols)
    d = df.crossJoin(F.broadcast(model))  # one row
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            sd = F.when(F.col(f"_sd{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_sd{i}"))
            out.append(((F.col(c) - F.col(f"_mu{i}")) / sd).alias(c + suffix))
            if suffix:
                out.append(F.col(c))
        else:
            out.append(F.col(c))
    return d.select(*out)


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return scaler_apply(df, scaler_fit(fit_on if fit_on is not None else df, cols), cols)


def forecast_frame(df: DataFrame, key: str = "city", time: str = "datetime", target: str = "target_next_hour",
                   features: Sequence[str] = FORECAST_FEATURES, levels: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows with a target; numeric features + key one-hot; median imputation; ``label``.
    Returns (frame with key, time, features..., label) and the feature column list."""
    d = df.where(F.col(target).isNotNull()).select(key, time, *features, F.col(target).cast("int").alias("label"))
    d, dummies = onehot(d, key, key, levels)
    cols = list(features) + dummies
    d = impute_median(d, list(features))
    return d, cols


def hash_order(id_cols: Sequence[str], seed: int = SEED):
    return F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed))


def _hash_rank(df: DataFrame, label: str, id_cols: Sequence[str], seed: int) -> DataFrame:
    """Position of each row inside its class in a seeded hash order. Rows are numbered per
    (class, hash bucket) in parallel; the bucket is the hash's top 10 bits."""
    h = hash_order(id_cols, seed)
    d = df.withColumn("_h", h)
    return index_rows(d, label, ["_h", *id_cols], bucket=F.shiftright(F.col("_h"), 54), rn_col="_hr")


def stratified_split(df: DataFrame, label: str = "label", id_cols: Sequence[str] = ("city", "datetime"),
                     test_fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """M4: exact stratified split: in each class the first round(test_fraction * n_class) rows of
    a seeded hash order are ``is_test`` = true. Deterministic; classes keep their shares."""
    d = _hash_rank(df, label, list(id_cols), seed)
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_ny"))
    d = d.join(n, label)
    return d.withColumn("is_test", F.col("_hr") <= F.round(F.col("_ny") * test_fraction)).drop("_h", "_hr", "_ny")


def stratified_folds(df: DataFrame, label: str = "label", id_cols: Sequence[str] = ("city", "datetime"),
                     k: int = 5, seed: int = SEED, fold_col: str = "fold") -> DataFrame:
    """M5: stratified k folds: fold = (position in the class's seeded hash order - 1) mod k."""
    d = _hash_rank(df, label, list(id_cols), seed)
    return d.withColumn(fold_col, ((F.col("_hr") - 1) % k).cast("int")).drop("_h", "_hr")
