import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeframe.operators import association as AS
from hazeframe.operators import evaluate as EV
from hazeframe.operators import prep as PR
from hazeframe.operators.stats import key_medians, key_quantiles


@pytest.mark.parametrize("q", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])
@pytest.mark.parametrize("kind", ["spread", "tied", "constant", "tiny"])
def test_quantiles_equal_the_exact_percentile(spark, kind, q):
    n = 13 if kind == "tiny" else 30_000
    v = {"spread": F.abs(F.xxhash64("id") % 1_000_003) / 7.0, "tied": F.floor(F.abs(F.xxhash64("id") % 3)).cast("double"),
         "constant": F.lit(4.25), "tiny": (F.col("id") * 7 % 5).cast("double")}[kind]
    key = F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, "cold").otherwise(F.lit(None))
    d = spark.range(n).select(key.alias("k"), F.when(F.col("id") % 11 > 0, v).alias("v"), (F.col("id") % 4).alias("u"))
    want = {r.k: (r.a, r.b) for r in d.groupBy("k").agg(F.percentile("v", q).alias("a"), F.percentile("u", q).alias("b")).collect()}
    got = {r.k: (r.a, r.b) for r in key_quantiles(d, "k", [("v", q, "a"), ("u", q, "b")]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    r = key_quantiles(d, None, [("v", q, "a")]).collect()
    assert len(r) == 1 and r[0].a == pytest.approx(d.agg(F.percentile("v", q)).first()[0], rel=1e-12)


def test_quantiles_without_values(spark):
    d = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    assert {r.k: r.m for r in key_medians(d, "k", ["v"], ["m"]).collect()} == {"a": None, "b": 1.0}
    assert [r.m for r in key_medians(d.where("k = 'a'"), None, ["v"], ["m"]).collect()] == [None]
    assert [r.m for r in key_medians(d.limit(0), None, ["v"], ["m"]).collect()] == [None]
    assert key_medians(d.limit(0), "k", ["v"], ["m"]).count() == 0

def _brute_rules(tx, min_support, min_conf, min_lift):
    n = len(tx)
    items = sorted({i for t in tx for i in t})
    sup = {}
    for size in range(1, 6):
        for combo in itertools.combinations(items, size):
            c = sum(1 for t in tx if set(combo) <= t)
            if c / n >= min_support:
                sup[frozenset(combo)] = c / n
    rules = set()
    for s, v in sup.items():
        if len(s) < 2:
            continue
        for r in range(1, len(s)):
            for a in itertools.combinations(sorted(s), r):
                a = frozenset(a)
                c = s - a
                conf = v / sup[a]
                if conf >= min_conf and conf / sup[c] >= min_lift:
                    rules.add((", ".join(sorted(a)), ", ".join(sorted(c))))
    return sup, rules


def test_itemsets_and_rules_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        city = rng.choice(["A", "B", "C"])
        season = "wet" if (city == "A" and rng.random() < 0.8) else rng.choice(["dry", "wet", "transition"])
        rows.append((str(city), str(season), int(rng.integers(0, 24)), int(rng.integers(0, 2)),
                     float(rng.choice([5.0, 20.0, 40.0, 100.0, 600.0]))))
    df = spark.createDataFrame(rows, "city string, season string, hour int, is_weekend int, pm25 double")
    tx = AS.transactions(df)
    its = AS.frequent_itemsets(tx, min_support=0.03)
    rules = AS.association_rules(its, 0.4, 1.1)
    txs = [set(r["items"]) for r in tx.collect()]
    sup, brute = _brute_rules(txs, 0.03, 0.4, 1.1)
    got = {frozenset(r["items"]): r["support"] for r in its.collect()}
    assert got.keys() == sup.keys()
    assert {(r["antecedents_str"], r["consequents_str"]) for r in rules.collect()} == brute
    assert len(brute) > 0
    fp = {frozenset(r["items"]) for r in AS.frequent_itemsets_baskets(tx, min_support=0.03).collect()}
    assert fp == set(sup.keys())


def test_roc_auc_and_metrics(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 500)
    s = np.round(np.clip(y * 0.3 + rng.random(500) * 0.7, 0, 1), 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    got = EV.roc_auc(df).first()["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    exp = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert math.isclose(got, exp, rel_tol=1e-12)
    curve = EV.roc_curve(df).collect()
    assert len(curve) == len(np.unique(s)) + 1
    m = EV.binary_metrics(df.withColumn("prediction", (F.col("score") > 0.5).cast("int"))).first()
    pred = (s > 0.5).astype(int)
    tp = ((pred == 1) & (y == 1)).sum()
    assert math.isclose(m["precision"], tp / pred.sum()) and math.isclose(m["recall"], tp / y.sum())
    cm = {(r["label"], r["prediction"]): r["n"] for r in EV.confusion(
        df.withColumn("prediction", F.lit(1))).collect()}
    assert cm[(0, 0)] == 0 and cm[(1, 1)] == y.sum()


def test_stratified_split_and_folds(spark):
    df = spark.range(1003).select(F.col("id").alias("rid"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    s = PR.stratified_split(df, "label", ["rid"], 0.2)
    c = {r["label"]: (r["n"], r["t"]) for r in s.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    for lab, (n, t) in c.items():
        assert t == round(0.2 * n)
    f = PR.stratified_folds(df, "label", ["rid"], 5)
    sizes = f.groupBy("label", "fold").count().collect()
    by = {}
    for r in sizes:
        by.setdefault(r["label"], []).append(r["count"])
    for v in by.values():
        assert max(v) - min(v) <= 1
    assert s.where("is_test").join(s.where("not is_test"), "rid").count() == 0


def test_roc_of_one_class_is_undefined(spark):
    for only in (0, 1):
        df = spark.createDataFrame([(only, 0.1, 0), (only, 0.4, 1), (only, 0.4, 1)], "label int, score double, prediction int")
        assert math.isnan(EV.roc_auc(df).first()["roc_auc"])
        pts = {r["threshold"]: (r["fpr"], r["tpr"]) for r in EV.roc_curve(df).collect()}
        assert set(pts) == {0.1, 0.4, math.inf} and pts[math.inf] == (0.0, 0.0)
        there = {0.1: 1.0, 0.4: 2 / 3}
        for at, rate in there.items():
            assert math.isclose(pts[at][only], rate) and math.isnan(pts[at][1 - only])
        row = EV.compare_models({"m": df}).first()
        assert math.isnan(row["roc_auc"]) and row["f1_rank"] == 1
    none = spark.createDataFrame([], "label int, score double")
    assert EV.roc_auc(none).first()["roc_auc"] is None and EV.roc_curve(none).count() == 1
