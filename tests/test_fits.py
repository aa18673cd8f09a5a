"""Trees, SVMs, k-means, mixtures, density clusters and prefix sums against plain NumPy and Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeframe.operators import classify as CL
from hazeframe.operators import cluster as CU
from hazeframe.operators import density as DE
from hazeframe.operators import evaluate as EV
from hazeframe.operators import kmeans as KM
from hazeframe.operators import mixture as MX
from hazeframe.operators import neighbors as NB
from hazeframe.operators import oneclass as OC
from hazeframe.operators import svm as SV
from hazeframe.operators import tree as TR
from hazeframe.operators.sequence import number_rows, running_totals


def frame(spark, x, **more):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), *[v[i].item() for v in more.values()]) for i, r in enumerate(x)]
    kinds = [f"{n} double" for n in names] + [f"{n} {'long' if v.dtype.kind == 'i' else 'double'}" for n, v in more.items()]
    return spark.createDataFrame(rows, "id long, " + ", ".join(kinds)), names


# ---- prefix sums --------------------------------------------------------------------------------

def test_running_totals_and_numbers(spark):
    rng = np.random.default_rng(0)
    rows = [(None if k == 3 else int(k), int(v), int(c)) for k, v, c in zip(rng.integers(0, 4, 500), rng.permutation(500), rng.integers(1, 9, 500))]
    df = spark.createDataFrame(rows, "k int, v int, c int")
    for exclusive in (False, True):
        got = {(r.k, r.v): r.t for r in running_totals(df, "k", ["v"], {"t": "c"}, exclusive).collect()}
        for k, v, c in rows:
            want = sum(d for j, w, d in rows if j == k and (w < v if exclusive else w <= v))
            assert got[k, v] == want
    assert [(r.v, r.n) for r in number_rows(df, ["v"], "n").orderBy("v").collect()] == [(i, i + 1) for i in range(500)]
    assert running_totals(df.limit(0), None, ["v"], {"t": "c"}).collect() == []


def test_running_totals_spread_a_hot_key(spark):
    """One key with all rows is dealt to several tasks."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), "id", F.lit(1).alias("one"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_totals(df, "k", ["id"], {"t": "one"})
        assert got.where("t <> id + 1").count() == 0
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert most < 200_000


def test_roc_with_crowded_scores(spark):
    rng = np.random.default_rng(3)
    s = np.round(10.0 ** -rng.uniform(3, 9, 600), 9)  # nearly all scores close to 0
    y = (rng.random(600) < 0.3 + 0.4 * (s > 1e-6)).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    got = EV.roc_auc(df).first()[0]
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(want)
    assert EV.roc_curve(df).count() == len(set(s)) + 1


# ---- neighbours ---------------------------------------------------------------------------------

def test_knn_with_a_third_of_all_rows_at_one_point(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (600, 3)), 2)
    x[:200] = 0.25
    df, feats = frame(spark, x)
    got = {}
    for r in NB.knn_join(df, df, 5, feats, ["id"], ["id"], exclude_self=True, leaf=32).collect():
        got.setdefault(r.q_id, []).append((r.nn_rank, r.p_id))
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted((round(float(v), 9), j) for j, v in enumerate(d) if j != i)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want], i


def test_knn_candidates_stay_flat(spark):
    """Candidates per query when the rows grow fourfold."""
    rng = np.random.default_rng(6)
    seen = []
    for n in (1500, 6000):
        x = np.column_stack([rng.exponential(1, n), rng.integers(0, 24, n) / 7, rng.integers(0, 7, n) / 2])
        df, feats = frame(spark, x)
        q, p, pairs = NB.leaf_pairs(df, df, 8, feats, ["id"], leaf=64)
        sized = pairs.join(q.select(F.col("cell").alias("a"), F.col("n").alias("na")), "a").join(p.select(F.col("cell").alias("b"), F.col("n").alias("nb")), "b")
        seen.append(sized.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] / n)
    assert seen[1] <= 1.5 * seen[0]


def test_knn_queries_apart_from_the_points(spark):
    rng = np.random.default_rng(7)
    p, q = rng.normal(0, 1, (300, 2)), np.vstack([rng.normal(9, 0.1, (150, 2)), [[100.0, -50.0]]])
    pts, feats = frame(spark, p)
    qs, _ = frame(spark, q)
    got = {}
    for r in NB.knn_join(qs, pts.withColumnRenamed("id", "pid"), 4, feats, ["id"], ["pid"], leaf=16).collect():
        got.setdefault(r.q_id, []).append((r.nn_rank, r.p_pid))
    for i in range(len(q)):
        want = np.argsort(((p - q[i]) ** 2).sum(1))[:4]
        assert [j for _, j in sorted(got[i])] == list(want)
    few = NB.knn_join(qs, pts.limit(2).withColumnRenamed("id", "pid"), 4, feats, ["id"], ["pid"])
    assert few.count() == 2 * len(q)  # fewer points than asked for: all of them
    assert NB.knn_join(qs, pts.limit(0).withColumnRenamed("id", "pid"), 4, feats, ["id"], ["pid"]).count() == 0


# ---- DBSCAN -------------------------------------------------------------------------------------

def plain_dbscan(x, eps, most):
    near = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= most
    label, c = -np.ones(len(x), int), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] == c:
                    continue
                if core[j]:
                    label[j] = c
                    todo += [int(t) for t in np.flatnonzero(near[j] & core & (label < 0))]
            c += 1
    border = [min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))]
    return np.where(core, label, border), core


@pytest.mark.parametrize("shape", ["blobs", "sheets", "copies", "line"])
def test_dbscan_matches_plain_python(spark, shape):
    rng = np.random.default_rng(8)
    if shape == "blobs":
        x = np.vstack([rng.normal(c, 0.3, (120, 2)) for c in ((0, 0), (2, 0), (0.9, 1.6))] + [rng.uniform(-2, 4, (60, 2))])
    elif shape == "sheets":  # two dense sheets a little farther apart than eps
        x = np.vstack([np.column_stack([rng.uniform(0, 3, 250), np.full(250, h), np.zeros(250)]) for h in (0.0, 0.52)])
    elif shape == "copies":  # a third of all rows at one point, and a constant column
        x = np.column_stack([np.round(rng.uniform(0, 4, 300), 1), np.full(300, 7.0)])
        x[:100, 0] = 2.05
    else:
        x = np.arange(200)[:, None] * 0.3
    df, feats = frame(spark, x)
    got = {r.id: (r.cluster, r.is_core) for r in DE.dbscan(df, feats, "id", eps=0.5, min_samples=6 if shape != "line" else 3).collect()}
    label, core = plain_dbscan(x, 0.5, 6 if shape != "line" else 3)
    assert [got[i][1] for i in range(len(x))] == list(core)
    assert [got[i][0] for i in range(len(x))] == list(label)


def test_dbscan_null_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.1), (2, None), (3, 9.0)], "id long, f0 double")
    got = {r.id: (r.cluster, r.is_core) for r in DE.dbscan(df, ["f0"], "id", eps=0.5, min_samples=2).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (-1, False), 3: (-1, False)}
    assert DE.dbscan(df.limit(0), ["f0"], "id", eps=0.5, min_samples=2).collect() == []


# ---- k-means and mixtures -----------------------------------------------------------------------

def blobs(n=400, seed=9):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.4, (n // 4, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4))])


def test_kmeans_finds_the_blobs_for_all_k_at_once(spark):
    x = blobs()
    df, feats = frame(spark, x)
    points = KM.vectors(df, feats, ["id"])
    fits = KM.fit(points, 2, [2, 4, 6], n_init=4)
    assert sorted(map(tuple, np.round(fits[4][0]))) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    for k, (c, s) in fits.items():
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        assert s[:, 1].sum() == pytest.approx(d.min(1).sum()) and s[:, 0].sum() == len(x)
    assert fits[2][1][:, 1].sum() > fits[4][1][:, 1].sum() > fits[6][1][:, 1].sum()
    sweep = {r.k: r for r in CU.k_sweep(df, feats, ["id"], ks=range(2, 7), n_init=3).collect()}
    assert [k for k, r in sweep.items() if r.best] == [4]
    lab = CU.kmeans_labels(df, feats, 4, n_init=4)
    assert lab.select("cluster").distinct().count() == 4
    assert CU.silhouette_squared(lab, feats, "cluster").first()[0] == pytest.approx(sweep[4].silhouette_squared, abs=1e-6)


def test_kmeans_moves_as_plain_lloyd(spark):
    x = blobs(seed=2)
    start = np.repeat([0, 1, 1, 2], len(x) // 4)
    df, feats = frame(spark, x, label=start)
    got = [r.cluster for r in CU.kmeans_from(df, feats, "label", 3).orderBy("id").collect()]
    c = np.array([x[start == g].mean(0) for g in range(3)])
    for _ in range(3):
        lab = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2).argmin(1)
        c = np.array([x[lab == g].mean(0) for g in range(3)])
    assert got == list(((x[:, None, :] - c[None, :, :]) ** 2).sum(2).argmin(1))


def test_mixture_steps_and_constant_columns(spark):
    x = np.column_stack([blobs(seed=4), np.full(400, 5.0)])
    start = np.repeat([0, 1, 1, 0], 100)
    df, feats = frame(spark, x, c0=start)
    got = MX.mixture(df, feats, "c0", 2, max_iter=3, tolerance=0.0).orderBy("id").collect()
    r = np.eye(2)[start]
    for _ in range(4):
        n = r.sum(0)
        mu = (r.T @ x) / n[:, None]
        dens = np.zeros((len(x), 2))
        for c in range(2):
            e = x - mu[c]
            cov = (r[:, c, None] * e).T @ e / n[c] + 1e-6 * np.eye(3)
            dens[:, c] = np.log(n[c] / len(x)) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1] - 0.5 * (e @ np.linalg.inv(cov) * e).sum(1)
        r = np.exp(dens - dens.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
    assert np.allclose([g.probability for g in got], r, atol=1e-6)
    full = CU.gmm_labels(df.drop("c0"), feats, 4).collect()
    assert len({g.cluster for g in full}) == 4
    assert all(abs(sum(g.probability) - 1) < 1e-9 for g in full)


def test_mixture_far_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 0), (5.0, 1), (5.1, 1), (1e6, 1), (None, 0)], "f0 double, c int")
    got = MX.mixture(df, ["f0"], "c", 2, max_iter=2).collect()
    assert all((g.cluster is None) == (g.f0 is None) for g in got)
    assert all(abs(sum(g.probability) - 1) < 1e-9 for g in got if g.f0 is not None)
    assert MX.mixture(df.limit(0), ["f0"], "c", 2).collect() == []


# ---- one-class SVM ------------------------------------------------------------------------------

def exact_oneclass(x, nu, gamma, steps=60_000):
    """Scores of the exact kernel problem: projected gradient on 0 <= a <= 1 / (nu n), sum a = 1."""
    k = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    n, cap = len(x), 1 / (nu * len(x))

    def project(v):
        lo, hi = v.min() - cap, v.max()
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
        return np.clip(v - (lo + hi) / 2, 0, cap)

    a = y = np.full(n, 1 / n)
    t, rate = 1.0, 1 / np.linalg.eigvalsh(k)[-1]
    for _ in range(steps):
        new = project(y - rate * (k @ y))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - a)
        done = np.abs(new - a).max() < 1e-13
        a, t = new, t2
        if done:
            break
    return k @ a


def test_oneclass_against_the_exact_problem(spark):
    """Rows on the margin tie at the limit in the exact solution, so either may flag them; all others must agree."""
    rng = np.random.default_rng(15)
    x = np.vstack([rng.normal(0, 1, (270, 2)), rng.normal(0, 4, (30, 2))])
    df, feats = frame(spark, x)
    scored, gap = OC.oneclass_scores(df, feats, landmarks=300)
    assert gap <= OC.GAP
    got = np.array([r.score for r in scored.orderBy("id").collect()])
    want = exact_oneclass(x, 0.05, 1 / (2 * x.var()), 20_000)
    assert np.abs(got - want).max() < 0.03 * want.max()
    limit, flag = np.quantile(want, 0.05), got < np.quantile(got, 0.05)
    assert abs(flag.mean() - 0.05) <= 0.005 and (flag == (want < limit)).mean() >= 0.95
    assert flag[want < 0.95 * limit].all() and not flag[want > 1.05 * limit].any()


def test_oneclass_nulls_copies_and_empty(spark):
    df = spark.createDataFrame([(float(i % 3), 1.0) for i in range(60)] + [(50.0, 1.0), (None, 1.0)], "f0 double, f1 double")
    got = [(r.f0, r.anomaly_ocsvm) for r in OC.oneclass_flag(df, ["f0", "f1"]).collect()]
    assert (50.0, True) in got and (None, False) in got and sum(f for _, f in got) == 1
    assert OC.oneclass_flag(df.limit(0), ["f0", "f1"]).collect() == []


# ---- trees and SVMs -----------------------------------------------------------------------------

def plain_tree(x, y, depth, min_split, min_leaf, w):
    def gini(c):
        t = c.sum()
        return 1 - ((c / t) ** 2).sum()

    def build(rows, left):
        n = np.array([(y[rows] == 0).sum(), (y[rows] == 1).sum()])
        node = {"p": n[1] * w[1] / (n * w).sum()}
        if not left or len(rows) < min_split or 0 in n:
            return node
        best = None
        for f in range(x.shape[1]):
            for v in sorted(set(x[rows, f]))[:-1]:
                a = rows[x[rows, f] <= v]
                if len(a) < min_leaf or len(rows) - len(a) < min_leaf:
                    continue
                ca = np.array([(y[a] == 0).sum(), (y[a] == 1).sum()]) * w
                cb = n * w - ca
                g = gini(n * w) - ca.sum() / (n * w).sum() * gini(ca) - cb.sum() / (n * w).sum() * gini(cb)
                key = (-round(g, 12), f, v)
                if best is None or key < best:
                    best = key
        if best is None:
            return node
        _, f, v = best
        nxt = min(u for u in x[rows, f] if u > v)
        node |= {"f": f, "t": v / 2 + nxt / 2, "l": build(rows[x[rows, f] <= v], left - 1), "r": build(rows[x[rows, f] > v], left - 1)}
        return node

    return build(np.arange(len(x)), depth)


def walk(node, row):
    while "f" in node:
        node = node["r"] if row[node["f"]] > node["t"] else node["l"]
    return node["p"]


def test_tree_matches_exhaustive_splits(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(0, 1, 500), rng.integers(0, 5, 500), rng.integers(0, 2, 500), np.full(500, 3.0)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 2) | (rng.random(500) < 0.1)).astype(int)
    df, feats = frame(spark, x, label=y)
    t = CL.tree_fit(df, feats, max_depth=4, min_split=30, min_leaf=12)
    w = np.array([500 / (2 * (y == 0).sum()), 500 / (2 * (y == 1).sum())])
    want = plain_tree(x, y, 4, 30, 12, w)
    got = CL.tree_predict(t, df, feats).orderBy("id").collect()
    assert np.allclose([g.score for g in got], [walk(want, r) for r in x])
    imp = {r.feature: r.importance for r in CL.feature_importance(t, feats, spark).collect()}
    assert sum(imp.values()) == pytest.approx(1.0) and imp["f3"] == 0.0


def test_trees_of_all_folds_grow_together(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (300, 2))
    y = (x[:, 0] + 0.2 * rng.normal(0, 1, 300) > 0).astype(int)
    df, feats = frame(spark, x, label=y, fold=np.arange(300) % 3)
    tagged = df.withColumn("to", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("to <> fold")
    many = TR.grow(tagged, feats, tree="to", max_depth=3, min_split=2, min_leaf=10)
    for f in range(3):
        alone = TR.grow(df.where(F.col("fold") != f), feats, max_depth=3, min_split=2, min_leaf=10)[0]
        assert alone.table() == many[f].table()
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "f0 double, label int")
    assert CL.tree_predict(CL.tree_fit(one, ["f0"]), one, ["f0"]).select("score").distinct().first()[0] == 1.0


def test_svm_meets_its_optimum(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(0, 1, (400, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.7 * rng.normal(0, 1, 400) > 0.8).astype(int)
    df, feats = frame(spark, x, label=y, fold=np.arange(400) % 3)
    fits = SV.fit_calibrated(df, feats, "label", "fold", 3)[0]
    xb = np.column_stack([x, np.ones(400)])
    for f, fit in enumerate(fits):
        on = np.arange(400) % 3 != f
        xs, s = xb[on], 2 * y[on] - 1
        c = np.where(s > 0, on.sum() / (2 * (s > 0).sum()), on.sum() / (2 * (s < 0).sum()))
        slack = np.maximum(0, 1 - s * (xs @ fit.w))
        assert np.abs(fit.w - 2 * xs.T @ (c * s * slack)).max() < 1e-4  # the gradient vanishes
        m, t = xb[~on] @ fit.w, y[~on]
        t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
        p = 1 / (1 + np.exp(fit.a * m + fit.b))
        assert abs((t - p).sum()) < 1e-3 and abs(((t - p) * m).sum()) < 1e-3
    got = df.withColumn("p", SV.probability(fits, feats)).select("label", "p").collect()
    assert np.mean([(r.p > 0.5) == r.label for r in got]) > 0.85


def test_cross_validation_equals_single_folds(spark):
    rng = np.random.default_rng(14)
    x = np.round(rng.normal(0, 1, (240, 2)), 2)
    y = (x[:, 0] + 0.5 * rng.normal(0, 1, 240) > 0).astype(int)
    df, feats = frame(spark, x, label=y, f=np.arange(240) % 3)
    got = {(r.model, r.fold): r.f1 for r in CL.cross_validate(df, feats, ["id"], k=3, fold="f").collect()}
    assert set(got) == {(m, f) for m in ("tree", "knn", "svm", "nb") for f in range(3)}
    for f in range(3):
        tr, te = df.where(F.col("f") != f), df.where(F.col("f") == f)
        nb = CL.gnb_predict(te, CL.gnb_fit(tr, feats), feats)
        assert EV.binary_metrics(nb).first().f1 == pytest.approx(got["nb", f])
    from hazeframe.operators import prep
    sc = prep.standardize(df, feats)
    kn = CL.knn_classify(sc.where("f <> 1"), sc.where("f = 1"), feats, ["id"])
    assert EV.binary_metrics(kn).first().f1 == pytest.approx(got["knn", 1])
