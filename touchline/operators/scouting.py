"""Similar profiles, level groups and principal components."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import ratio
from touchline.operators.ordered import top_rows
from touchline.operators.ranking import union_all
from touchline.session import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def standardised(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Population z-scores inside a group, as `z_<column>`."""
    stats = df.groupBy(*groups).agg(*[e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.join(stats, groups)
    return out.withColumns({f"z_{c}": F.coalesce(ratio(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}"), F.lit(0.0)) for c in columns}).drop(
        *[f"_{p}_{c}" for c in columns for p in "ms"])


def most_similar(df: DataFrame, targets: DataFrame, groups: list[str], ident: str, vector: str, k: int) -> DataFrame:
    """The k rows nearest by cosine to each group's target row.

    One target per group: every row meets one vector, so work grows with the rows and no pairs are listed.
    """
    t = targets.select(*groups, F.col(ident).alias("target"), F.col(vector).alias("_t"))
    rows = df.join(t, groups).filter(F.col(ident) != F.col("target"))
    v = F.col(vector)
    cos = ratio(dot(v, F.col("_t")), F.sqrt(dot(v, v)) * F.sqrt(dot(F.col("_t"), F.col("_t"))))
    scored = rows.select(*groups, "target", ident, F.round(cos, 9).alias("similarity"))
    return top_rows(scored, [*groups, "target"], [F.desc("similarity"), F.asc(ident)], k)


def leaders(df: DataFrame, groups: list[str], value: str, ident: str, k: int, eligible: Column | None = None) -> DataFrame:
    """Top k per group by a total or a rate, with an optional minimum."""
    d = df if eligible is None else df.filter(eligible)
    return top_rows(d.filter(F.col(value).isNotNull()), groups, [F.desc(value), F.asc(ident)], k)


def _features(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def level_groups(df: DataFrame, columns: list[str], output: str, k: int = 3, seed: int = 42, starts: int = 2) -> DataFrame:
    """K-means on standardised columns, groups renamed 0..k-1 by their mean of `output`.

    The best of `starts` fits; Spark's parallel seeding spreads the centres already, so few are needed.
    """
    data = _features(stored(df), columns)
    models = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster", maxIter=30).fit(data) for i in range(starts)]
    fitted = min(models, key=lambda m: m.summary.trainingCost).transform(data)
    means = fitted.groupBy("cluster").agg(F.avg(output).alias("_m"))
    order = sorted(means.collect(), key=lambda r: r["_m"])  # k rows
    level = F.lit(None).cast("int")
    for i, row in enumerate(order):
        level = F.when(F.col("cluster") == row["cluster"], i).otherwise(level)
    return fitted.withColumn("level", level).drop("features", "cluster")


def level_groups_by(df: DataFrame, group: str, values: list[str], columns: list[str], output: str, k: int = 3, seed: int = 42,
                    starts: int = 2) -> DataFrame:
    """Levels fitted apart in each of the listed groups; rows of other groups are left out."""
    return union_all([level_groups(df.filter(F.col(group) == v), columns, output, k, seed, starts) for v in values])


def silhouette_by_k(df: DataFrame, group: str, values: list[str], columns: list[str], ks: list[int], seed: int = 42) -> DataFrame:
    """Mean silhouette per group and number of clusters."""
    score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    rows = []
    for value in values:
        data = _features(stored(df.filter(F.col(group) == value).select(*columns)), columns)
        rows += [(value, k, float(score.evaluate(KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=20)
                                                 .fit(data).transform(data)))) for k in ks]
    return df.sparkSession.createDataFrame(rows, f"{group} string, k int, silhouette double")


def principal_components(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Loadings and explained variance of the first k components, one row per column and component."""
    fitted = PCA(k=k, inputCol="features", outputCol="pc").fit(_features(df, columns))
    loadings, explained = fitted.pc.toArray(), fitted.explainedVariance.toArray()
    rows = [(c, j + 1, float(loadings[i, j]), float(explained[j])) for i, c in enumerate(columns) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, "column string, component int, loading double, explained double")


def level_mix(levels: DataFrame, group: str) -> DataFrame:
    """Share of each level per group."""
    n = levels.groupBy(group, "level").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy(group).agg(F.sum("n").alias("_t"))
    return n.join(t, group).withColumn("share", ratio("n", "_t")).drop("_t")


def label_drift(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How many members changed level between two trainings."""
    j = before.select(key, F.col("level").alias("a")).join(after.select(key, F.col("level").alias("b")), key, "full")
    return j.agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("a") != F.col("b")).alias("changed"),
                 F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("in_one_only"))


def vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(column))
