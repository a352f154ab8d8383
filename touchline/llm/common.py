"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import shared_folder

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The frame written as a table to the folder that the cluster shares, and read from there.

    It survives lost executors, and is dealt out anew by the joins that follow, so that Spark can split their large keys.
    """
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, stem: str) -> str:
    """Path of a folder, not there yet, in the folder that the cluster shares."""
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid4().hex}"


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in slices of at most so many rows, so that a worker holds the results of few rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch[at:at + rows]
        del batch
        pa.default_memory_pool().release_unused()


def slices_by_size(batches: Iterator[pa.Array], most: int = 4 << 20, rows: int = 256) -> Iterator[pa.Array]:
    """Arrow arrays of texts or bytes in slices of at most so many rows and bytes; one longer value is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, size in enumerate(sizes):
            if i > at and (total + size > most or i - at == rows):
                yield batch[at:i]
                at, total = i, 0
            total += int(size)
        yield batch[at:]
        del batch
        pa.default_memory_pool().release_unused()


def text_of(column: str | Column) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def own_name(df: DataFrame, stem: str) -> str:
    """A helper column's name that clashes with none of the frame's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def split_hash(*columns: Column, seed: int) -> Column:
    """Even number in [0, 1) drawn from a seeded hash of the columns: 52 bits of an MD5, so that SQL engines agree."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Smallest reachable node of every linked node, by alternating star contraction.

    `edges`: columns a, b of one orderable type, any direction, repeats allowed. Returns node, component; nodes without a
    link to another node are absent. Each round first hangs every larger neighbour of a node on that node's smallest one,
    then does so for the smaller neighbours; the number of rounds grows with the logarithm of the longest chain. The edge
    set never grows, every round is written to the shared folder, and a node with very many links is only aggregated by
    (partial minima) or joined with the one row of its minimum, which Spark can split.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seal = _seal(current)
    for _ in range(rounds):
        current = stored(_star(_star(current, both=True), both=False))
        before, seal = seal, _seal(current)
        if seal == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One contraction: a > b in every edge; neighbours of a node move to its smallest neighbour."""
    if both:  # every node with all its neighbours; only the larger ones move
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # every node with its smaller neighbours
        sides = edges
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = sides.join(least, "a")
    if both:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _seal(edges: DataFrame):
    """Size and sum of row hashes of an edge set: equal sets have equal ones."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
