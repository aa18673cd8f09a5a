"""Association analysis over categorical conditions.

Each transaction holds exactly one item per categorical column, so an itemset with two items of
the same column never occurs and the frequent itemsets are exactly the cells of
``cube(columns)`` (minus the grand total) whose share reaches ``min_support``: one grouped
aggregation with map-side partial aggregation, instead of candidate generation rounds.
For free-form baskets (an ``array<string>`` column) ``pyspark.ml.fpm.FPGrowth`` does the mining.

Rules consider every non-empty proper subset of a frequent itemset as antecedent (not only
single-item consequents as ``FPGrowth.associationRules`` does). Supports of antecedent and
consequent come from equi-joins on the canonical (sorted, joined) itemset string. The itemset
table is bounded: per subset of the k columns at most 1/min_support cells can reach
min_support, so it has at most (2^k - 1) / min_support rows and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.functions import scalars as S

TRANSACTION_COLUMNS = ["city", "season", "time_period", "day_type", "pm25_level"]
MIN_SUPPORT = 0.03
MIN_CONFIDENCE = 0.4
MIN_LIFT = 1.1
LEVEL_PREFIX = "pm25_level="


def transactions(df: DataFrame, key: str = "city", value: str = "pm25", hour: str = "hour",
                 weekend: str = "is_weekend", season: str = "season") -> DataFrame:
    """Categorical columns (missing -> 'nan') and the item array per row."""
    d = df.select(
        S.str_or_nan(key).alias("city"),
        S.str_or_nan(season).alias("season"),
        S.str_or_nan(S.time_period(hour)).alias("time_period"),
        S.str_or_nan(S.day_type(weekend)).alias("day_type"),
        S.str_or_nan(S.pm25_level(value)).alias("pm25_level"))
    return d.withColumn("items", F.array(*[F.concat(F.lit(c + "="), F.col(c)) for c in TRANSACTION_COLUMNS]))


def frequent_itemsets(tx: DataFrame, columns: Sequence[str] = TRANSACTION_COLUMNS,
                      min_support: float = MIN_SUPPORT) -> DataFrame:
    """(items array sorted, itemset string, freq, support, length) for every itemset
    with support >= min_support."""
    cols = list(columns)
    # distinct baskets first: the cube expands this small table, not the raw rows
    baskets = tx.groupBy(*cols).agg(F.count(F.lit(1)).alias("_w"))
    n = baskets.agg(F.sum("_w").alias("_N"))
    cells = baskets.cube(*cols).agg(F.sum("_w").alias("freq"),
                               *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(cols)])
    present = [F.when(F.col(f"_g{i}") == 0, F.concat(F.lit(c + "="), F.col(c))) for i, c in enumerate(cols)]
    items = F.array_sort(F.filter(F.array(*present), lambda x: x.isNotNull()))
    d = (cells.where(reduce(lambda a, b: a | b, [F.col(f"_g{i}") == 0 for i in range(len(cols))]))
              .crossJoin(F.broadcast(n))  # one row
              .select(items.alias("items"), F.col("freq").cast("long").alias("freq"),
                      (F.col("freq") / F.col("_N")).alias("support")))
    return (d.where(F.col("support") >= min_support)
             .withColumn("itemset", F.array_join("items", ", "))
             .withColumn("length", F.size("items").cast("int")))


def frequent_itemsets_baskets(baskets: DataFrame, items_col: str = "items",
                              min_support: float = MIN_SUPPORT) -> DataFrame:
    """M29 for arbitrary baskets: FP-growth (distributed, PFP) on an ``array<string>`` column."""
    from pyspark.ml.fpm import FPGrowth
    model = FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=1.0).fit(baskets)
    n = baskets.agg(F.count(F.lit(1)).alias("_N"))
    d = model.freqItemsets.crossJoin(F.broadcast(n))
    return d.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"),
                    (F.col("freq") / F.col("_N")).alias("support"),
                    F.array_join(F.array_sort("items"), ", ").alias("itemset"),
                    F.size("items").cast("int").alias("length"))


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE,
                      min_lift: float | None = MIN_LIFT) -> DataFrame:
    """All rules A -> C from every frequent itemset (A, C non-empty, disjoint, A u C =
    itemset) with confidence >= min_confidence, then lift >= min_lift."""
    multi = itemsets.where(F.col("length") >= 2)
    masks = F.expr("sequence(1, (1 << length) - 2)")  # every non-empty proper subset
    ex = multi.select("items", "support", F.explode(masks).alias("_m"))

    def part(bit: int):
        # item i belongs to the antecedent when bit i of the mask is set
        return F.expr(f"filter(items, (x, i) -> ((_m >> i) & 1) = {bit})")

    rules = ex.select(F.array_join(part(1), ", ").alias("antecedents_str"),
                      F.array_join(part(0), ", ").alias("consequents_str"),
                      part(1).alias("antecedent"), part(0).alias("consequent"), "support")
    sup = itemsets.select("itemset", F.col("support").alias("_s"))
    rules = (rules.join(sup.withColumnRenamed("_s", "antecedent_support"),
                        F.col("antecedents_str") == F.col("itemset"), "inner").drop("itemset")
                  .join(sup.withColumnRenamed("_s", "consequent_support"),
                        F.col("consequents_str") == F.col("itemset"), "inner").drop("itemset"))
    rules = (rules.withColumn("confidence", F.col("support") / F.col("antecedent_support"))
                  .withColumn("lift", F.col("confidence") / F.col("consequent_support")))
    rules = rules.where(F.col("confidence") >= min_confidence)
    if min_lift is not None:
        rules = rules.where(F.col("lift") >= min_lift)
    return rules


def _rule_order():
    return [F.desc("lift"), F.col("antecedents_str"), F.col("consequents_str")]


def rank_rules(rules: DataFrame) -> DataFrame:
    """T5: position by lift descending (ties by antecedent, then consequent string)."""
    return rules.withColumn("lift_rank", F.row_number().over(Window.orderBy(*_rule_order())).cast("int"))


def top_rules(rules: DataFrame, n: int = 20) -> DataFrame:
    """T5: the ``n`` rules with the highest lift."""
    return rank_rules(rules).where(F.col("lift_rank") <= n)


def rules_with_level(rules: DataFrame, prefix: str = LEVEL_PREFIX) -> DataFrame:
    """P10: rules mentioning a level item on either side."""
    return rules.where(F.col("antecedents_str").contains(prefix) | F.col("consequents_str").contains(prefix))


def rules_by_consequent(rules: DataFrame, levels: Sequence[str] = S.PM25_LEVEL_LABELS, top: int = 3,
                        prefix: str = LEVEL_PREFIX) -> DataFrame:
    """For each level, the rules whose consequent holds ``prefix + level``, top ``top``
    by lift, with the level's rule count. A consequent holds at most one item of the level column,
    so the level is read off the consequent string (no level x rule pairing)."""
    level = F.regexp_extract("consequents_str", prefix.replace(".", "\\.") + "([^,]+)", 1)
    d = rules.withColumn("level", level).where(F.col("level").isin(list(levels)))
    w = Window.partitionBy("level")
    d = (d.withColumn("level_rules", F.count(F.lit(1)).over(w).cast("long"))
          .withColumn("level_rank", F.row_number().over(w.orderBy(*_rule_order())).cast("int")))
    return d.where(F.col("level_rank") <= top)


def top_single_items(itemsets: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` single items with the highest support (ties by item)."""
    d = itemsets.where(F.col("length") == 1).select(F.element_at("items", 1).alias("item"), "support")
    return (d.withColumn("support_rank", F.row_number().over(Window.orderBy(F.desc("support"), "item")).cast("int"))
             .where(F.col("support_rank") <= n))


def itemset_lengths(itemsets: DataFrame) -> DataFrame:
    """Number of frequent itemsets per length."""
    return itemsets.groupBy("length").agg(F.count(F.lit(1)).cast("long").alias("n_itemsets"))


def rule_labels(rules: DataFrame, n: int = 15, width: int = 60) -> DataFrame:
    """``antecedent → consequent`` cut to ``width`` characters plus '...', for the top ``n``."""
    return top_rules(rules, n).select("lift_rank", S.rule_label("antecedents_str", "consequents_str", width)
                                      .alias("rule"), "lift", "confidence")
