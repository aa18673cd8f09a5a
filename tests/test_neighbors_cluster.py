import numpy as np
from pyspark.sql import functions as F

from hazeframe.operators import anomaly as AN
from hazeframe.operators import cluster as CU
from hazeframe.operators import density as DE
from hazeframe.operators.components import connected_components
from hazeframe.operators.neighbors import knn_join, range_join


def _points(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    X = np.vstack([rng.normal(0, 1, (n // 2, 3)), rng.normal(4, 0.5, (n // 2, 3))])
    X[10] = X[11]  # a duplicate point
    X = np.round(X, 3)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(X)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double"), X


def test_knn_join_exact(spark):
    df, X = _points(spark)
    got = knn_join(df, df, 5, ["x", "y", "z"], ["id"], ["id"], exclude_self=True)
    g = {}
    for r in got.collect():
        g.setdefault(r["q_id"], []).append((r["nn_rank"], r["p_id"], r["dist"]))
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    for i in range(len(X)):
        d = D[i].copy()
        d[i] = np.inf
        order = sorted(range(len(X)), key=lambda j: (round(d[j], 9), j))[:5]
        assert [p for _, p, _ in sorted(g[i])] == order


def test_range_join_pair_count(spark):
    df, X = _points(spark)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    assert range_join(df, 0.8, ["x", "y", "z"], ["id"]).count() == int((D <= 0.8).sum())


def _sk_dbscan(X, eps, min_samples):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    nb = [np.where(D[i] <= eps)[0] for i in range(n)]
    core = np.array([len(x) >= min_samples for x in nb])
    labels = -np.ones(n, int)
    c = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = c
        stack = [i]
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for q in nb[j]:
                if labels[q] == -1:
                    labels[q] = c
                    stack.append(q)
        c += 1
    return labels, core


def test_dbscan_matches_sequential(spark):
    df, X = _points(spark, n=300, seed=4)
    out = DE.dbscan(df.withColumnRenamed("id", "row_id"), ["x", "y", "z"], "row_id", eps=0.6, min_samples=8)
    got = {r["row_id"]: (r["cluster"], r["is_core"]) for r in out.collect()}
    lab, core = _sk_dbscan(X, 0.6, 8)
    for i in range(len(X)):
        assert got[i][1] == core[i]
        assert got[i][0] == lab[i], i  # border points too: the lowest-numbered neighbouring cluster


def test_knn_leaves_no_query_out(spark):
    # clustered, discrete and far-out coordinates: many rounds are needed
    rows = [(i, float(i % 3), float(i % 7) * 1e-4, 0.0 if i % 50 else 10.0 ** (i // 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {}
    for r in knn_join(df, df, 6, ["x", "y", "z"], ["id"], ["id"], exclude_self=True).collect():
        got.setdefault(r.q_id, []).append((r.nn_rank, round(r.dist, 9), r.p_id))
    pts = np.array([r[1:] for r in rows])
    for i in range(len(rows)):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(1))
        want = sorted((round(float(x), 9), j) for j, x in enumerate(d) if j != i)[:6]
        assert [(x, j) for _, x, j in sorted(got[i])] == want


def test_lof_scores_and_flags(spark):
    df, X = _points(spark, n=200)
    s = AN.lof_flag(AN.lof_scores(df, ["x", "y", "z"], ["id"], k=10), 0.05)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(D, np.inf)
    nb = np.argsort(D, axis=1, kind="stable")[:, :10]
    kd = np.take_along_axis(D, nb, 1)[:, -1]
    lrd = np.array([1 / (np.maximum(D[i, nb[i]], kd[nb[i]]).mean() + 1e-10) for i in range(len(X))])
    for r in s.collect():
        assert abs(r.lof - lrd[nb[r.id]].mean() / lrd[r.id]) < 1e-6
    r = s.agg(F.avg(F.col("anomaly_lof").cast("int")).alias("a"), F.min("lof").alias("m")).first()
    assert 0.0 < r["a"] <= 0.06 and r["m"] > 0


def test_silhouette_and_ch(spark):
    df, X = _points(spark, n=200)
    lab = df.withColumn("label", (F.col("id") >= 100).cast("int"))
    sil = CU.silhouette(lab, ["x", "y", "z"], "label", ["id"]).first()["silhouette"]
    y = (np.arange(len(X)) >= 100).astype(int)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    s = []
    for i in range(len(X)):
        same = y == y[i]
        a = D[i, same].sum() / (same.sum() - 1)
        b = D[i, ~same].mean()
        s.append((b - a) / max(a, b))
    assert abs(sil - np.mean(s)) < 1e-12
    S2 = D ** 2
    t = []
    for i in range(len(X)):
        same = y == y[i]
        a, b = S2[i, same].sum() / (same.sum() - 1), S2[i, ~same].mean()
        t.append((b - a) / max(a, b))
    got = CU.silhouette_squared(lab, ["x", "y", "z"], "label").first()[0]
    assert abs(got - np.mean(t)) < 1e-9
    one = lab.withColumn("label", (F.col("id") == 3).cast("int"))  # a cluster of one scores 0
    assert CU.silhouette_squared(one, ["x", "y", "z"], "label").first()[0] is not None
    assert CU.silhouette_squared(lab.withColumn("label", F.lit(1)), ["x", "y", "z"], "label").first()[0] is None
    ch = CU.calinski_harabasz(lab, ["x", "y", "z"], "label").first()[0]
    mu = X.mean(0)
    B = sum((y == c).sum() * ((X[y == c].mean(0) - mu) ** 2).sum() for c in (0, 1))
    W = sum(((X[y == c] - X[y == c].mean(0)) ** 2).sum() for c in (0, 1))
    assert abs(ch - (B / 1) / (W / (len(X) - 2))) < 1e-6 * ch


def test_connected_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5)], "src long, dst long")
    v = spark.createDataFrame([(i,) for i in [1, 2, 3, 5, 10, 11, 20]], "id long")
    got = {r["id"]: r["component"] for r in connected_components(e, v).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 10: 10, 11: 10, 20: 20}
