"""Anomaly detectors and their summaries.

* z-score: one global mean / population std (a one-row table) -> |z| > 3.
* local outlier factor: exact 20-NN self join (adaptive cells, ``neighbors.knn_join``), k-distance,
  reachability, local reachability density, LOF; flagged when -LOF is below its 5 % percentile.
* one-class SVM: ``oneclass``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.operators import prep
from hazeframe.operators.neighbors import knn_join
from hazeframe.operators.oneclass import oneclass_flag
from hazeframe.operators.sequence import materialize
from hazeframe.operators.stats import key_medians, key_quantiles

Z_THRESHOLD = 3.0
LOF_K = 20
LOF_CONTAMINATION = 0.05
OCSVM_NU = 0.05
TRIO = ["anomaly_zscore", "anomaly_lof", "anomaly_ocsvm"]


def zscore_flag(df: DataFrame, value: str = "pm25", threshold: float = Z_THRESHOLD, out: str = "anomaly_zscore") -> DataFrame:
    """|(v - mean) / population std| > threshold over the whole table (NULL -> median first)."""
    med = key_medians(df, None, [value], ["_md"])
    v = F.coalesce(F.col(value), F.col("_md"))
    d = df.crossJoin(F.broadcast(med))  # one row
    st = d.agg(F.avg(v).alias("_mu"), F.stddev_pop(v).alias("_sd"))  # over the imputed column
    z = F.abs((v - F.col("_mu")) / F.col("_sd"))
    return (d.crossJoin(F.broadcast(st))  # one row
              .withColumn(out, F.coalesce(z > threshold, F.lit(False)))
              .drop("_mu", "_sd", "_md"))


def lof_scores(df: DataFrame, feats: Sequence[str], ids: Sequence[str], k: int = LOF_K) -> DataFrame:
    """(ids, lof) with LOF = mean lrd(neighbours) / lrd(p), lrd = 1 / (mean reach + 1e-10)."""
    ids = list(ids)
    nn = materialize(knn_join(df, df, k, feats, ids, ids, exclude_self=True))
    qk, pk = [f"q_{c}" for c in ids], [f"p_{c}" for c in ids]
    kdist = nn.groupBy(*qk).agg(F.max("dist").alias("_kd"))
    reach = nn.join(kdist.select(*[F.col(a).alias(b) for a, b in zip(qk, pk)], "_kd"), pk) \
        .withColumn("_reach", F.greatest(F.col("dist"), F.col("_kd")))
    lrd = reach.groupBy(*qk).agg((1.0 / (F.avg("_reach") + 1e-10)).alias("_lrd"))
    lrd = materialize(lrd)
    m = (nn.join(lrd.select(*[F.col(a).alias(b) for a, b in zip(qk, pk)], F.col("_lrd").alias("_lrdo")), pk)
           .groupBy(*qk).agg(F.avg("_lrdo").alias("_mo")))
    out = lrd.join(m, qk).select(*[F.col(a).alias(c) for a, c in zip(qk, ids)],
                                 (F.col("_mo") / F.col("_lrd")).alias("lof"))
    return out


def lof_flag(scores: DataFrame, contamination: float = LOF_CONTAMINATION, out: str = "anomaly_lof") -> DataFrame:
    """Flag rows whose -LOF lies strictly below the ``contamination`` percentile of -LOF."""
    thr = key_quantiles(scores.select((-F.col("lof")).alias("_neg")), None, [("_neg", contamination, "_thr")])
    return scores.crossJoin(F.broadcast(thr)).withColumn(out, -F.col("lof") < F.col("_thr")).drop("_thr")  # one row


def ocsvm_flag(df: DataFrame, feats: Sequence[str], nu: float = OCSVM_NU, out: str = "anomaly_ocsvm") -> DataFrame:
    """Rows outside the one-class SVM (RBF kernel, gamma = 1 / (features x variance)); see ``oneclass``."""
    return oneclass_flag(df, feats, nu, out)


def detector_trio(df: DataFrame, feats: Sequence[str], ids: Sequence[str], value: str = "pm25") -> DataFrame:
    """``df`` with the flags of all three detectors (z-score, LOF, one-class SVM) and their consensus; the last two work on
    ``feats`` standardised over all rows."""
    ids = list(ids)
    p = materialize(df)
    af = materialize(prep.standardize(p.select(*ids, *feats), list(feats)))
    lof = lof_flag(lof_scores(af, feats, ids)).drop("lof")
    oc = ocsvm_flag(af, feats).select(*ids, "anomaly_ocsvm")
    return materialize(consensus(zscore_flag(p, value).join(lof, ids).join(oc, ids), TRIO))


def consensus(df: DataFrame, flags: Sequence[str], need: int = 2, out: str = "anomaly_consensus") -> DataFrame:
    """Flagged by at least ``need`` of the methods; ``n_methods`` = number agreeing."""
    n = reduce(lambda a, b: a + b, [F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags])
    return df.withColumn("n_methods", n.cast("int")).withColumn(out, F.col("n_methods") >= need)


def anomaly_rates(df: DataFrame, flags: Sequence[str], dims: Sequence[str] = ("city", "season", "month", "hour")) -> DataFrame:
    """Percentage flagged per method, overall and per value of each dimension, in one pass
    (GROUPING SETS). Output long: (dim, value, method, rate_pct)."""
    dims = list(dims)
    # rows with the same dimensions are added up first: the grouping sets expand that small table
    small = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f).cast("int")).alias(f"_f{i}") for i, f in enumerate(flags)])
    sets = [[], *[[F.col(d)] for d in dims]]
    wide = small.groupingSets(sets, *dims).agg(
        *[F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)],
        *[(F.sum(f"_f{i}") / F.sum("_n") * 100).alias(f) for i, f in enumerate(flags)])
    dim, val = F.lit("all"), F.lit("all")
    for i, d in enumerate(dims):
        dim = F.when(F.col(f"_g{i}") == 0, F.lit(d)).otherwise(dim)
        val = F.when(F.col(f"_g{i}") == 0, F.col(d).cast("string")).otherwise(val)
    wide = wide.select(dim.alias("dim"), val.alias("value"), *flags)
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("method"), F.col(f"`{f}`").alias("rate_pct")) for f in flags]))
    return wide.select("dim", "value", stack.alias("s")).select("dim", "value", "s.method", "s.rate_pct")


def anomaly_days(df: DataFrame, flag: str, key: str = "city", time: str = "datetime", value: str = "pm25") -> DataFrame:
    """Daily mean and number of flagged rows per key; only days with at least one."""
    d = df.groupBy(key, F.to_date(time).alias("date")).agg(F.avg(value).alias(f"{value}_mean"),
                                                           F.sum(F.col(flag).cast("long")).alias("n_anomalies"))
    return d.where(F.col("n_anomalies") > 0)


def agreement_hist(df: DataFrame, n_col: str = "n_methods") -> DataFrame:
    """Number of rows per number of agreeing methods."""
    return df.groupBy(n_col).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


def method_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Number of flagged rows per method."""
    row = df.agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in flags])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("method"), F.col(f).alias("n_flagged"))
                                          for f in flags])).alias("s")).select("s.*")


def top_anomalies(df: DataFrame, flag: str, n: int = 10, value: str = "pm25", key: str = "city",
                  time: str = "datetime") -> DataFrame:
    """The ``n`` flagged rows with the highest value (ties: key, time)."""
    order = [F.desc(value), F.col(key), F.col(time)]
    top = df.where(F.col(flag)).select(time, key, value).orderBy(*order).limit(n)  # per-partition top-n, merged
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))  # n rows
