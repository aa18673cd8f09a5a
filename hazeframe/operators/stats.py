"""Exact medians and quantiles per key: one plan for every size.

1. One aggregation sketches every column (``percentile_approx``, deterministic rank error of at
   most ``n / ACCURACY``) at a fixed grid of ranks and counts its values. The two grid points around
   a wanted quantile, widened by one, bracket it.
2. One pass over the values adds up, per (key, quantile), the rows below the bracket, the next values
   on both sides, and a count per distinct value inside it. Equal values are one row from here on, so
   ties and constant columns cost nothing.
3. Running counts over the distinct values inside the bracket (about ``4 / GRID`` of the
   column), dealt by ranges of about equal size, find the order statistics, which are interpolated at
   position ``(n - 1) q``.

No task holds a key, a column or a bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.operators.sequence import running_totals

ACCURACY = 10_000
GRID = 1000  # ranks of the sketch that are asked for; a bracket spans up to four steps


def _keys(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def key_medians(df: DataFrame, keys, cols: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One row per key with the exact median of each column (NULLs ignored) as ``names``."""
    names = list(names) if names is not None else [f"med_{c}" for c in cols]
    return key_quantiles(df, keys, [(c, 0.5, n) for c, n in zip(cols, names)])


def key_quantiles(df: DataFrame, keys, specs: Sequence[tuple[str, float, str]]) -> DataFrame:
    """One row per key with the exact quantile (linear interpolation between order statistics,
    position (n - 1) q) for each (column, q, name) in ``specs``; NULL where a column has no value.

    NULL keys are a key of their own. Without keys the result is one row.
    """
    keys = _keys(keys)
    ks = [f"_k{i}" for i in range(len(keys))]
    cols = list(dict.fromkeys(c for c, _, _ in specs))
    base = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])

    # 1. sketch: per column the grid of ranks needed around its quantiles
    grid = {c: sorted({j for x, q, _ in specs if x == c for j in _around(q)}) for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(f"_v{i}").alias(f"_n{i}"),
                 F.percentile_approx(f"_v{i}", [j / GRID for j in grid[c]], ACCURACY).alias(f"_g{i}")]
    sketch = base.groupBy(*ks).agg(*aggs)

    # a bracket per (key, quantile)
    rows = []
    for s, (c, q, _) in enumerate(specs):
        i, (lo, hi) = cols.index(c), _around(q)
        n = F.col(f"_n{i}")
        at = (n - 1) * F.lit(float(q))
        inf = F.lit(math.inf)
        rows.append(F.struct(
            F.lit(s).alias("s"), F.lit(i).alias("i"), at.alias("at"), (F.floor(at) + 1).alias("r1"), (F.ceil(at) + 1).alias("r2"),
            # the outermost grid points take in the column's ends
            (F.lit(-math.inf) if lo == 0 else F.get(f"_g{i}", F.lit(grid[c].index(lo)))).alias("lo"),
            (inf if hi == GRID else F.get(f"_g{i}", F.lit(grid[c].index(hi)))).alias("hi")))
    brackets = F.array(*rows)

    # 2. rows below, next values outside, and a count per distinct value inside
    wide = _join_keys(base, sketch.select(*ks, brackets.alias("_b")), ks)
    value = F.coalesce(*[F.when(F.col("b.i") == i, F.col(f"_v{i}")) for i in range(len(cols))])
    long = wide.select(*ks, *[f"_v{i}" for i in range(len(cols))], F.explode("_b").alias("b"))
    long = long.select(*ks, "b.s", "b.at", "b.r1", "b.r2", "b.lo", "b.hi", value.alias("x")).where(F.col("x").isNotNull())
    side = F.when(F.col("x") < F.col("lo"), -1).when(F.col("x") > F.col("hi"), 1).otherwise(0)
    part = (long.withColumn("side", side)
            .groupBy(*ks, "s", "at", "r1", "r2", "side", F.when(F.col("side") == 0, F.col("x")).alias("v"))
            .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"), F.max("x").alias("most")))

    # 3. running counts; the rows outside stand for the nearest value on their side
    run = running_totals(part, [*ks, "s"], ["side", "v"], {"upto": "c"})
    x = F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least"))
    first = lambda r: F.min(F.when(F.col("upto") >= F.col(r), x))
    picked = run.groupBy(*ks, "s", "at", "r1").agg(first("r1").alias("x1"), first("r2").alias("x2"))
    low = F.col("r1") - 1
    # the same interpolation as Spark's exact percentile
    out = F.when(F.col("at") == low, F.col("x1")).otherwise(
        (low + 1 - F.col("at")) * F.col("x1") + (F.col("at") - low) * F.col("x2"))
    picked = picked.select(*ks, "s", out.alias("x")).groupBy(*ks).agg(
        *[F.max(F.when(F.col("s") == s, F.col("x"))).alias(n) for s, (_, _, n) in enumerate(specs)])
    names = [n for _, _, n in specs]
    full = _join_keys(sketch.select(*ks), picked, ks, "left")  # keys without any value keep their row
    return full.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], *names)


def _around(q: float) -> tuple[int, int]:
    """Grid ranks below and above quantile q, one step wider than needed."""
    return max(0, math.floor(q * GRID) - 1), min(GRID, math.ceil(q * GRID) + 1)


def _join_keys(a: DataFrame, b: DataFrame, ks: list[str], how: str = "inner") -> DataFrame:
    """Join on the key columns, NULL equal to NULL; without keys both sides share one row."""
    if not ks:
        return a.join(F.broadcast(b), F.lit(True), how)  # b is one row
    b = b.select(*[F.col(k).alias(f"{k}_r") for k in ks], *[c for c in b.columns if c not in ks])
    cond = None
    for k in ks:
        c = F.col(k).eqNullSafe(F.col(f"{k}_r"))
        cond = c if cond is None else cond & c
    return a.join(b, cond, how).drop(*[f"{k}_r" for k in ks])
