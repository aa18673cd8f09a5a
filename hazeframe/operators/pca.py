"""Principal components (M23, W9) with ``pyspark.ml.feature.PCA``.

The fit reduces the data to a d x d covariance matrix (distributed) and decomposes it on the
driver (d = number of features, tiny). ``transform`` does not centre, so inputs are standardised
first. Component signs are fixed so that each component's largest absolute loading is positive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pca_fit(df: DataFrame, feats: Sequence[str], k: int | None = None):
    from pyspark.ml.feature import PCA, VectorAssembler
    feats = list(feats)
    k = k or len(feats)
    d = VectorAssembler(inputCols=feats, outputCol="_x").transform(df)
    model = PCA(k=k, inputCol="_x", outputCol="_pcs").fit(d)
    pc = model.pc.toArray()  # d x k loadings (model metadata)
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    return model, signs


def explained_variance(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Ratio and cumulative ratio per component."""
    model, _ = pca_fit(df, feats)
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    t = df.sparkSession.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)], "component int, ratio double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)  # one row per component
    return t.withColumn("cumulative", F.sum("ratio").over(w))


def components_needed(ratios: DataFrame, thresholds: Sequence[float] = (0.90, 0.95)) -> DataFrame:
    """Smallest number of components whose cumulative ratio reaches each threshold."""
    rows = [F.struct(F.lit(t).alias("threshold"),
                     F.min(F.when(F.col("cumulative") >= t - 1e-12, F.col("component"))).alias("n_components"))
            for t in thresholds]
    return ratios.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def loadings(df: DataFrame, feats: Sequence[str], k: int = 3) -> DataFrame:
    """Loadings of the first ``k`` components (sign fixed): (component, feature, loading)."""
    model, signs = pca_fit(df, feats)
    pc = model.pc.toArray()
    rows = [(j + 1, f, float(pc[i, j] * signs[j])) for j in range(min(k, pc.shape[1])) for i, f in enumerate(feats)]
    return df.sparkSession.createDataFrame(rows, "component int, feature string, loading double")


def pca_scores(df: DataFrame, feats: Sequence[str], k: int = 2, prefix: str = "pca_") -> DataFrame:
    """Scores on the first ``k`` components as columns ``pca_1 .. pca_k`` next to the input columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    model, signs = pca_fit(df, feats, k)
    out = model.transform(VectorAssembler(inputCols=list(feats), outputCol="_x").transform(df))
    arr = vector_to_array("_pcs")
    return out.select(*df.columns, *[(arr[j] * signs[j]).alias(f"{prefix}{j + 1}") for j in range(k)])
