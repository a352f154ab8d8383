"""Average ranks, percentiles and rank statistics from counts of distinct values.

Rows are first reduced to (group, value) counts; ranks are running counts inside value ranges plus the totals of the
ranges below, so no task ever sorts a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numeric import pearson, ratio

RANGES = 128
PLAIN = 20_000  # different values of a group up to which they are one range


def value_ranges(counts: DataFrame, keys: list[str], value: str, ranges: int) -> DataFrame:
    """Add `_n` rows in the group and `_b`, a value range of one row per value: 0 in groups of few values, else cut at quantiles.

    The quantiles come from a sketch of the group's values, so that ranges hold like numbers of them however they are spread.
    """
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
    counts = counts.join(sizes, keys)
    edges = counts.filter(F.col("_d") > PLAIN).groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), [k / ranges for k in range(1, ranges)], 20 * ranges).alias("_e"))
    v = F.col(value).cast("double")
    place = F.when(F.col("_e").isNull(), 0).otherwise(F.size(F.filter("_e", lambda e: e < v)))
    return counts.join(edges, keys, "left").withColumn("_b", place.cast("int")).drop("_d", "_e")


def value_counts_ranked(df: DataFrame, groups: list[str], value: str, measures: dict | None = None,
                        ranges: int = RANGES) -> DataFrame:
    """One row per (group, value): `_c` rows, `_rank` average rank, `_n` rows in the group, plus measures."""
    measures = measures or {}
    keys = groups or ["_all"]
    base = df.filter(F.col(value).isNotNull())
    if not groups:
        base = base.withColumn("_all", F.lit(0))
    counts = base.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_c"), *[e.alias(n) for n, e in measures.items()])
    counts = value_ranges(counts, keys, value, ranges)
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ladder = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_m"))
    ladder = ladder.withColumn("_below", F.coalesce(F.sum("_m").over(below), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = counts.join(ladder, [*keys, "_b"]).withColumn(
        "_rank", F.col("_below") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
        + (F.col("_c") + 1) / 2.0)
    return ranked.drop("_b", "_below") if groups else ranked.drop("_b", "_below", "_all")


def with_average_rank(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Add the average rank of `value` in its group (NULL for NULL)."""
    table = value_counts_ranked(df, groups, value).select(*groups, value, F.col("_rank").alias(out))
    return df.join(table, [*groups, value], "left")


def percentile_in_group(df: DataFrame, value: str, groups: list[str], eligible, out: str) -> DataFrame:
    """Percentile 0-100 (average rank / n) among eligible rows; others get NULL."""
    held = df.withColumn("_v", F.when(eligible, F.col(value)))
    table = value_counts_ranked(held, groups, "_v").select(
        *groups, "_v", (100.0 * F.col("_rank") / F.col("_n")).alias(out))
    return held.join(table, [*groups, "_v"], "left").drop("_v")


def rank_correlation(df: DataFrame, groups: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Spearman correlation per group over complete pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *groups, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = with_average_rank(pairs, groups, "_x", "_rx")
    pairs = with_average_rank(pairs, groups, "_y", "_ry")
    return pairs.groupBy(*groups).agg(pearson("_rx", "_ry").alias(out), F.count("_x").alias("pairs"))


def auc(df: DataFrame, groups: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve from average ranks; ties count half."""
    table = value_counts_ranked(df, groups, score, {"_pos": F.sum(F.col(positive).cast("int"))})
    sums = table.groupBy(*groups).agg(
        F.sum("_pos").alias("positives"), F.sum(F.col("_c") - F.col("_pos")).alias("negatives"),
        F.sum(F.col("_rank") * F.col("_pos")).alias("_r"))
    p, n = F.col("positives"), F.col("negatives")
    return sums.withColumn("auc", ratio(F.col("_r") - p * (p + 1) / 2.0, p * n)).drop("_r")


def rank_sum_test(df: DataFrame, groups: list[str], value: str, in_first: str) -> DataFrame:
    """Mann-Whitney U with tie correction and continuity: U of the first sample, z of the normal form and two-sided p."""
    from touchline.operators.inference import two_sided_p

    table = value_counts_ranked(df, groups, value, {"_f": F.sum(F.col(in_first).cast("int"))})
    c = F.col("_c").cast("double")
    sums = table.groupBy(*groups).agg(
        F.sum("_f").alias("n1"), F.sum(F.col("_c") - F.col("_f")).alias("n2"),
        F.sum(F.col("_rank") * F.col("_f")).alias("_r"), F.sum(c * c * c - c).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - ratio(F.col("_ties"), n * (n - 1)))
    gap = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0))
    out = sums.withColumn("u", u).withColumn("z", ratio(gap, F.sqrt(var))).drop("_r", "_ties")
    return out.withColumn("p_value", two_sided_p("z"))


def correlation_pairs(df: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns in one aggregate, one row per pair."""
    groups = groups or []
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.groupBy(*groups).agg(*[pearson(a, b).alias(f"{a}~{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"),
                              F.col(f"`{a}~{b}`").alias("r")) for a, b in pairs])
    return wide.select(*groups, F.explode(rows).alias("p")).select(*groups, "p.*")


def linear_edges_tercile(df: DataFrame, groups: list[str], value: str, tie: str, out: str,
                         tie_span: int = 100_000) -> DataFrame:
    """Terciles of first-come ranks (numeric tie-break) with linear-quantile edges, per group."""
    key = [*groups, value]
    ranked = value_counts_ranked(df, groups, value).select(
        *key, (F.col("_rank") - (F.col("_c") - 1) / 2.0).alias("_start"), "_n")
    # ties are numbered inside ranges of the tie-break, so one frequent value does not fill a task
    rows = df.withColumn("_part", F.floor(F.col(tie) / tie_span))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_k"))
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    w = Window.partitionBy(*key, "_part").orderBy(tie)
    placed = rows.join(ranked, key).join(sizes, [*key, "_part"]).withColumn(
        "_pos", F.col("_start") + F.col("_off") + F.row_number().over(w) - 1)
    low, high = 1 + (F.col("_n") - 1) / 3.0, 1 + 2 * (F.col("_n") - 1) / 3.0
    level = F.when(F.col("_pos") <= low, 0).when(F.col("_pos") <= high, 1).otherwise(2)
    return placed.withColumn(out, level).drop("_start", "_n", "_part", "_off", "_pos")


def concentration(df: DataFrame, keys: list[str], amount: str, target: float = 0.8,
                  out: str = "needed") -> DataFrame:
    """Fewest members, largest first, that reach `target` of the group's amount (0 for an empty total).

    Members with equal amounts are counted together first, so a window holds distinct amounts only.
    """
    levels = df.filter(F.col(amount).isNotNull()).groupBy(*keys, amount).agg(
        F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*keys).orderBy(F.col(amount).desc())
    run = by.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(*keys)
    a = F.col(amount).cast("double")
    levels = (levels.withColumn("_tot", F.sum(a * F.col("_c")).over(everyone))
              .withColumn("_cum", F.coalesce(F.sum(a * F.col("_c")).over(run), F.lit(0.0)))
              .withColumn("_k", F.coalesce(F.sum("_c").over(run), F.lit(0))))
    short = (F.lit(target) - 1e-12) * F.col("_tot") - F.col("_cum")
    here = F.col("_k") + F.greatest(F.ceil(F.try_divide(short, a)), F.lit(1))
    reached = F.col("_cum") + a * F.col("_c") >= (F.lit(target) - 1e-12) * F.col("_tot")
    return levels.groupBy(*keys).agg(
        F.coalesce(F.min(F.when((F.col("_tot") > 0) & (a > 0) & reached, here)), F.lit(0))
        .cast("bigint").alias(out))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gini coefficient per group from average ranks of distinct values."""
    table = value_counts_ranked(df, keys, value)
    v = F.col(value)
    return table.groupBy(*keys).agg(
        F.sum((2 * F.col("_rank") - F.col("_n") - 1) * v * F.col("_c")).alias("_num"),
        F.sum(v * F.col("_c")).alias("_sum"), F.max("_n").alias("members")).select(
        *keys, "members",
        F.when(F.col("_sum") > 0, F.col("_num") / (F.col("members") * F.col("_sum"))).alias("gini"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
