"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is what its target share of the budget needs, over its size. Every document draws its number
of copies by inverting the Poisson distribution of that rate at a number hashed from its key and a seed, is repeated so
often, and all copies are dealt out and ordered by a hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import own_name, split_hash, stored

SEED = 17
BROADCAST_SOURCES = 2_000  # rates of at most so many sources go to every executor; more are joined by a shuffle
PART = 500.0  # a rate above this is drawn as a sum of Poisson numbers of equal smaller rates


def rates(df: DataFrame, weights: Mapping[str, float], source: str = "source", text: str = "text", other: float = 1.0,
          budget: float | None = None) -> DataFrame:
    """(source, size, rate): characters and mean repetition rate of every source.

    `weights` are relative target weights of sources, `other` that of each source not named (null is such a source).
    `budget` is the wanted size in characters, by default the input's. A source of empty texts only has rate 1.
    """
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("double")).alias("size"))
    named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    weight = F.coalesce(F.element_at(named, F.col("source")).cast("double") if weights else F.lit(None), F.lit(float(other)))
    sizes = stored(sizes.withColumn("weight", weight))
    total = sizes.agg(F.sum("weight").alias("w"), F.sum("size").alias("s"))
    wanted = F.lit(float(budget)) if budget is not None else total.select("s").scalar()
    share = F.col("weight") / total.select("w").scalar()
    return sizes.select("source", "size", F.when(F.col("size") > 0, share * wanted / F.col("size")).otherwise(1.0).alias("rate"))


def _distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities from 0 up to where hashed numbers of 52 bits end."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, j: Column) -> Column:
        p = s["p"] * rate / j
        return F.struct(p.alias("p"), F.concat(s["all"], F.array(F.element_at(s["all"], -1) + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["all"])


def mixed(df: DataFrame, weights: Mapping[str, float], source: str = "source", text: str = "text", key: str = "doc_id",
          other: float = 1.0, budget: float | None = None, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """`df` with every row repeated by its Poisson number (often 0), dealt out and ordered by hash.

    Rows with equal keys draw equal numbers; a null key is a key like any other. `copy` names a column for the copy's
    number, from 1. The columns of `df` are kept. An empty frame gives an empty frame.
    """
    r, s, n, o = (own_name(df, x) for x in ("rate", "source", "copy", "order"))
    found = stored(rates(df, weights, source, text, other, budget))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    found = found.select(F.col("source").alias(s), F.struct(parts.alias("parts"), _distribution(F.col("rate") / parts).alias("upto")).alias(r))
    if found.count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)

    def drawn(part: Column) -> Column:
        u = split_hash(F.col(key), part, seed=seed)
        return F.size(F.filter(F.col(r)["upto"], lambda c: c <= u))

    number = F.aggregate(F.sequence(F.lit(1), F.col(r)["parts"]), F.lit(0), lambda a, part: a + drawn(part))
    rows = df.join(found, F.col(source).eqNullSafe(F.col(s)))
    rows = rows.select(*[df[c] for c in df.columns], number.alias(r)).where(F.col(r) > 0)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col(r))).alias(n))
    rows = rows.withColumn(o, F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("~")), F.col(n))))
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(width, o).sortWithinPartitions(o)
    return rows.select(*df.columns, *([F.col(n).alias(copy)] if copy else []))
