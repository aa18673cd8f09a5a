"""Clustering and cluster quality.

K-means (all restarts and all k in the same passes), Gaussian mixtures and DBSCAN are in ``kmeans``, ``mixture``
and ``density``.
``silhouette_squared`` is the silhouette of squared distances over all rows, from per-cluster sums;
``silhouette`` is the Euclidean form of the analysed pipeline on an explicit seeded sample, and says
how many rows it saw. Calinski-Harabasz and Davies-Bouldin are grouped aggregates over the full data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.operators import kmeans, mixture, prep
from hazeframe.operators.neighbors import range_join
from hazeframe.operators.sequence import materialize

SEED = 42
N_INIT = 10
K_RANGE = range(2, 11)
SILHOUETTE_SAMPLE = 5000
DBSCAN_EPS = 0.8
DBSCAN_MIN_SAMPLES = 50


def cluster_frame(df: DataFrame, feats: Sequence[str] = prep.CLUSTER_FEATURES,
                  ids: Sequence[str] = ("city", "datetime")) -> DataFrame:
    """Ids + median-imputed, standardised (population std) features."""
    d = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in feats])
    d = prep.impute_median(d, feats)
    return prep.standardize(d, feats)


def kmeans_fit(df: DataFrame, feats: Sequence[str], k: int, n_init: int = N_INIT, seed: int = SEED):
    """Best (lowest SSE) of ``n_init`` seeded k-means fits, all moved together. Returns (centres, sse)."""
    centres, sums = kmeans.fit(kmeans.vectors(df, feats), len(feats), [k], n_init, seed)[k]
    return centres, float(sums[:, 1].sum())


def kmeans_labels(df: DataFrame, feats: Sequence[str], k: int, n_init: int = N_INIT, seed: int = SEED) -> DataFrame:
    centres, _ = kmeans_fit(df, feats, k, n_init, seed)
    return df.withColumn("cluster", kmeans.nearest(feats, centres))


def kmeans_from(df: DataFrame, feats: Sequence[str], label: str, steps: int) -> DataFrame:
    """``df`` with ``cluster`` after ``steps`` moves of centres that start at the means of an integer column's
    groups, in ascending order."""
    means = df.groupBy(label).agg(*[F.avg(f).alias(f) for f in feats]).where(F.col(label).isNotNull()).orderBy(label).collect()  # a row a start
    start = np.array([[r[f] for f in feats] for r in means], float)
    centres, _ = kmeans.lloyd(kmeans.vectors(df, feats), len(feats), [start], max_iter=steps, tolerance=-1.0)[0]
    return df.withColumn("cluster", kmeans.nearest(feats, centres))


def k_sweep(df: DataFrame, feats: Sequence[str], ids: Sequence[str], ks=K_RANGE, n_init: int = N_INIT,
            seed: int = SEED) -> DataFrame:
    """SSE, Euclidean silhouette (seeded sample) and silhouette of squared distances (all rows)
    for each k; ``best`` marks the first k with the top Euclidean silhouette.

    Passes over the rows serve all k and all restarts.
    """
    points = kmeans.vectors(df, feats, ids)
    fits = kmeans.fit(points, len(feats), list(ks), n_init, seed)
    squared = kmeans.squared_silhouettes(points, len(feats), [fits[k] for k in ks])
    sample = silhouette_sample(df.select(*ids, *feats), ids or feats, seed=seed)
    wide = sample.select(*feats, *[kmeans.nearest(feats, fits[k][0]).alias(f"_l{k}") for k in ks])
    plain = sample_silhouettes(wide, feats, [f"_l{k}" for k in ks])
    rows = [(int(k), float(fits[k][1][:, 1].sum()), a, b) for k, a, b in zip(ks, plain, squared)]
    t = df.sparkSession.createDataFrame(rows, "k int, sse double, silhouette double, silhouette_squared double")
    w = Window.orderBy(F.desc_nulls_last("silhouette"), "k")  # at most len(ks) rows
    return t.withColumn("best", F.row_number().over(w) == 1)


def gmm_labels(df: DataFrame, feats: Sequence[str], k: int, seed: int = SEED) -> DataFrame:
    """Full-covariance Gaussian mixture from a k-means start; ``cluster`` = most probable component and its
    membership probabilities."""
    started = kmeans_labels(df, feats, k, 1, seed).withColumnRenamed("cluster", "_c0")
    return mixture.mixture(started, feats, "_c0", k)


# ---- neighbour counts (J8) -----------------------------------------------------------------------------

def dbscan_core(df: DataFrame, feats: Sequence[str], id_col: str = "row_id", eps: float = DBSCAN_EPS,
                min_samples: int = DBSCAN_MIN_SAMPLES) -> DataFrame:
    """Points with ``n_neighbors`` (within eps, self included) and ``is_core``.

    Pairs are counted as they are joined (partial aggregation); none is stored. ``density.dbscan`` finds
    the core points without counting them all.
    """
    cnt = (range_join(df, eps, feats, [id_col]).groupBy(F.col(f"q_{id_col}").alias(id_col))
           .agg(F.count(F.lit(1)).cast("long").alias("n_neighbors")))
    pts = df.join(cnt, id_col, "left").withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0)).cast("long"))
    return pts.withColumn("is_core", F.col("n_neighbors") >= min_samples)


# ---- quality metrics (M16, M19-M21) -------------------------------------------------------------

def silhouette_sample(df: DataFrame, ids: Sequence[str], size: int = SILHOUETTE_SAMPLE, seed: int = SEED) -> DataFrame:
    """The ``size`` rows with the smallest seeded hash (all rows when there are fewer)."""
    return df.withColumn("_h", prep.hash_order(list(ids), seed)).orderBy("_h", *ids).limit(size).drop("_h")


def silhouette_squared(df: DataFrame, feats: Sequence[str], label: str) -> DataFrame:
    """Mean silhouette of squared Euclidean distances over all rows; a point alone in its cluster
    scores 0; NULL below two clusters.

    The mean squared distance of x to a cluster is ``|x|^2 - 2 x.m + q`` with the cluster's mean m and
    mean square norm q, so one row per cluster is all a point needs. Rows meet the clusters one by
    one (rows x clusters, streamed through an aggregation per row).
    """
    feats = list(feats)
    d = df.select(*feats, F.col(label).alias("_l")).where(F.col("_l").isNotNull())
    norm = reduce(lambda a, b: a + b, [F.col(f) * F.col(f) for f in feats])
    cl = d.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"), F.avg(norm).alias("_q"), *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(feats)])
    each = F.sort_array(F.collect_list(F.struct("_l", "_n", "_q", F.array(*[f"_m{i}" for i in range(len(feats))]).alias("m"))))
    all_cl = cl.agg(each.alias("_c"))  # one row: a struct a cluster
    x = F.array(*feats)
    dot = lambda m: F.aggregate(F.zip_with(x, m, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    dist = F.transform("_c", lambda c: F.struct((c["_l"] == F.col("_l")).alias("own"), c["_n"].alias("n"),
                                                F.greatest(F.col("_x2") - 2 * dot(c["m"]) + c["_q"], F.lit(0.0)).alias("d")))
    own = F.get(F.filter("_d", lambda c: c["own"]), 0)
    other = F.array_min(F.transform(F.filter("_d", lambda c: ~c["own"]), lambda c: c["d"]))
    scored = (d.withColumn("_x2", norm).join(F.broadcast(all_cl), F.lit(True))  # one row
              .withColumn("_d", dist).select(own.alias("o"), other.alias("b")))
    a = F.col("o.d") * F.col("o.n") / (F.col("o.n") - 1)  # own mean without the point itself
    s = F.when(F.col("o.n") == 1, F.lit(0.0)).when(F.greatest(a, F.col("b")) == 0, F.lit(0.0)).otherwise(
        (F.col("b") - a) / F.greatest(a, F.col("b")))
    return scored.agg(F.avg(F.when(F.col("b").isNotNull(), s)).alias("silhouette_squared"))


def sample_silhouettes(sample: DataFrame, feats: Sequence[str], labels: Sequence[str]) -> list[float | None]:
    """Mean Euclidean silhouette over the rows of a bounded sample, per label column (NULL labels left out).

    The sample (its bound is the caller's) goes to every task; each scores its rows for all columns.
    """
    feats, labels = list(feats), list(labels)
    sample = materialize(sample.select(*feats, *labels))
    local = sample.toPandas()  # bounded sample
    x = local[feats].to_numpy(dtype=float)
    groups = []
    for c in labels:
        y = local[c].to_numpy(dtype=float)
        seen = np.unique(y[~np.isnan(y)])
        groups.append((seen, (y[:, None] == seen[None, :]).astype(float)))

    def score(batches):
        for rb in batches:
            q = np.stack([rb.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(feats))], 1)
            dist = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) if len(q) else np.zeros((0, len(x)))
            out = []
            for j, (seen, member) in enumerate(groups):
                y = rb.column(len(feats) + j).to_numpy(zero_copy_only=False).astype(float)
                ok = np.flatnonzero(~np.isnan(y))
                if len(seen) < 2 or not len(ok):
                    continue
                own, rows = np.searchsorted(seen, y[ok]), np.arange(len(ok))
                total, n = dist[ok] @ member, member.sum(0)
                a = total[rows, own] / np.maximum(n[own] - 1, 1)
                mean = total / n[None, :]
                mean[rows, own] = np.inf
                b = mean.min(axis=1)
                s = np.where((n[own] > 1) & (np.maximum(a, b) > 0), (b - a) / np.where(np.maximum(a, b) > 0, np.maximum(a, b), 1), 0.0)
                out.append((j, float(s.sum()), len(ok)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], names=["j", "s", "n"])

    got = sample.mapInArrow(score, "j int, s double, n long").groupBy("j").agg((F.sum("s") / F.sum("n")).alias("m")).collect()  # a row a column
    found = {r["j"]: r["m"] for r in got}
    return [found.get(j) for j in range(len(labels))]


def silhouette(df: DataFrame, feats: Sequence[str], label: str, ids: Sequence[str],
               size: int = SILHOUETTE_SAMPLE, seed: int = SEED) -> DataFrame:
    """Mean silhouette (Euclidean) over a seeded sample of at most ``size`` rows, as the analysed
    pipeline asks for, with n_rows and n_sampled; a point alone in its cluster scores 0; NULL when
    the sample has fewer than 2 clusters."""
    feats, ids = list(feats), list(ids)
    kept = df.where(F.col(label).isNotNull()).select(*dict.fromkeys([*ids, *feats, label]))
    sample = materialize(silhouette_sample(kept, ids or feats, size, seed))
    value = sample_silhouettes(sample, feats, [label])[0]
    return df.sparkSession.createDataFrame([(value, kept.count(), sample.count())], "silhouette double, n_rows long, n_sampled long")


def calinski_harabasz(df: DataFrame, feats: Sequence[str], label: str) -> DataFrame:
    """(B / (k - 1)) / (W / (n - k)); NULL with fewer than 2 clusters."""
    feats = list(feats)
    cen = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"), *[F.avg(f).alias(f"_c{i}") for i, f in enumerate(feats)])
    tot = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f"_g{i}") for i, f in enumerate(feats)])
    w = (df.join(cen, label)  # one row per cluster
           .agg(F.sum(reduce(lambda a, b: a + b, [F.pow(F.col(f) - F.col(f"_c{i}"), 2) for i, f in enumerate(feats)]))
                .alias("_W")))
    b = (cen.crossJoin(tot)  # tot is one row
            .agg(F.sum(F.col("_nc") * reduce(lambda a, b: a + b, [F.pow(F.col(f"_c{i}") - F.col(f"_g{i}"), 2)
                                                                  for i in range(len(feats))])).alias("_B"),
                 F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n")))
    return b.crossJoin(w).select(
        F.when(F.col("_k") >= 2, (F.col("_B") / (F.col("_k") - 1)) / (F.col("_W") / (F.col("_n") - F.col("_k"))))
        .alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, feats: Sequence[str], label: str) -> DataFrame:
    """Mean over clusters of max_j (S_i + S_j) / d(c_i, c_j), S = mean distance to centroid."""
    feats = list(feats)
    cen = df.groupBy(label).agg(*[F.avg(f).alias(f"_c{i}") for i, f in enumerate(feats)])
    s = (df.join(cen, label)  # one row per cluster
           .withColumn("_d", F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(f) - F.col(f"_c{i}"), 2)
                                                               for i, f in enumerate(feats)])))
           .groupBy(label).agg(F.avg("_d").alias("_s")))
    c = cen.join(s, label)
    x = c.select(*[F.col(n).alias("a" + n) for n in c.columns])
    y = c.select(*[F.col(n).alias("b" + n) for n in c.columns])
    dij = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(f"a_c{i}") - F.col(f"b_c{i}"), 2) for i in range(len(feats))]))
    # cluster x cluster on the centroid table (k rows)
    r = (x.join(y, F.col("a" + label) != F.col("b" + label))
          .groupBy("a" + label).agg(F.max((F.col("a_s") + F.col("b_s")) / dij).alias("_r")))
    return r.agg(F.avg("_r").alias("davies_bouldin"))


def evaluate_clustering(df: DataFrame, feats: Sequence[str], label: str, ids: Sequence[str], method: str) -> DataFrame:
    """One metric row with noise (-1) removed; metrics NULL below 2 rows or 2 clusters. ``silhouette`` is the
    Euclidean one on the seeded sample, ``silhouette_squared`` that of squared distances over all rows."""
    spark = df.sparkSession
    counts = df.agg(F.count_distinct(F.when(F.col(label) != -1, F.col(label))).cast("long").alias("n_clusters"),
                    F.sum((F.col(label) == -1).cast("long")).alias("noise_points"),
                    F.sum((F.col(label) != -1).cast("long")).alias("_kept")).first()
    clean = df.where(F.col(label) != -1)
    if (counts["_kept"] or 0) < 2 or counts["n_clusters"] < 2:
        plain = sil = ch = db = None
    else:
        plain = silhouette(clean, feats, label, ids).first()["silhouette"]
        sil = silhouette_squared(clean, feats, label).first()[0]
        ch = calinski_harabasz(clean, feats, label).first()[0]
        db = davies_bouldin(clean, feats, label).first()[0]
    return spark.createDataFrame([(method, int(counts["n_clusters"]), int(counts["noise_points"] or 0), plain, sil, ch, db)],
                                 "method string, n_clusters long, noise_points long, silhouette double, silhouette_squared double, "
                                 "calinski_harabasz double, davies_bouldin double")


# ---- cluster profiles (A28-A30) -------------------------------------------------------------------

def cluster_profile(df: DataFrame, label: str = "cluster", key: str = "city", value: str = "pm25",
                    flag: str = "is_unhealthy") -> DataFrame:
    """Mean / sample std / count of ``value``, flagged %, most frequent key (smallest on ties)."""
    return df.groupBy(label).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"),
                                 F.count(F.lit(1)).cast("long").alias("n"),
                                 (F.avg(flag) * 100).alias("unhealthy_pct"),
                                 F.mode(key, deterministic=True).alias(f"top_{key}"))


def crosstab_share(df: DataFrame, row: str, label: str = "cluster", row_order: Sequence[str] | None = None) -> DataFrame:
    """Share of each ``row`` value within each cluster (columns sum to 1), zeros included;
    with ``row_order`` exactly those row values (absent ones NULL)."""
    counts = df.groupBy(row, label).agg(F.count(F.lit(1)).alias("_n"))
    tot = df.groupBy(label).agg(F.count(F.lit(1)).alias("_t"))
    rows = df.select(row).distinct() if row_order is None else \
        df.sparkSession.createDataFrame([(v,) for v in row_order], f"{row} string")
    present = df.select(row).distinct().withColumn("_present", F.lit(True))
    grid = rows.crossJoin(tot)  # the cells of the report: row values x clusters
    out = (grid.join(counts, [row, label], "left").join(present, row, "left")
               .select(row, label, F.when(F.col("_present"), F.coalesce(F.col("_n"), F.lit(0)) / F.col("_t"))
                       .alias("share")))
    return out
