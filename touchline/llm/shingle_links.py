"""Near-duplicates by the similarity of their word shingles: shared ones over all different ones.

Texts with equal sets of shingles collapse first. Different sets are candidates if their SimHash fingerprints share a one-wildcard
segment (`simhash_links.near_sets`); sets of a similarity of 0.8 do so with chance 0.99999, more alike ones above. What the links of
candidates join is a block. Every text of a block of at most BLOCK_SETS sets moves once, to one task, where sets are compared
exactly: a member reached is compared with those not reached yet.

In a larger block no task sees more than a tile. Its sets are dealt out by BANDS bands of ROWS minima of seeded hashes, which sets
of similarity s share with chance 1 - (1 - s^ROWS)^BANDS, 0.99994 at 0.8: every set is first compared with the smallest set of each
of its bands; then, in bands that still hold sets not joined, tiles of about TILE sets are compared with each other, tiles of one
joined component never with themselves. Both ways compare exactly all that share a band and are not joined already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.llm import simhash_links
from touchline.llm.common import components, slices, slices_by_size, stored
from touchline.llm.simhash_links import SEED, kept_rows, wide_fingerprint_of

ROWS, BANDS = 6, 32
BLOCK = 4096  # shingle hashes whose minima are taken at a time
BLOCK_SETS = 256  # sets of a block that one task reads; those of larger blocks are dealt out in tiles
TILE = 128  # sets of a tile, on average
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: str | None, words: int) -> np.ndarray:
    """Sorted different XXH64 of the `words`-word shingles; words are those of a fingerprint, a text of fewer is one shingle."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    pieces = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    return np.unique(np.array([xxhash.xxh64_intdigest(p, SEED) for p in pieces], np.uint64))


def bands_of(shingles: np.ndarray) -> list[int]:
    """Signed hash of every band's minima; none for an empty set."""
    if not len(shingles):
        return []
    least = np.min([(shingles[at:at + BLOCK, None] * FACTORS).min(axis=0) for at in range(0, len(shingles), BLOCK)], axis=0)
    digests = [xxhash.xxh64_digest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.frombuffer(b"".join(digests), np.int64).tolist()


def sketch(text: Column, words: int) -> Column:
    """struct<f long, print array<long>>: hash of a text's set of shingles, and its wide fingerprint."""

    @arrow_udf("f long, print array<long>")
    def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            sets = [shingles_of(t.as_py(), words) for t in texts]
            f = [int.from_bytes(xxhash.xxh64_digest(s.tobytes(), SEED), "big", signed=True) for s in sets]
            prints = [wide_fingerprint_of(s).view(np.int64) for s in sets]
            yield pa.StructArray.from_arrays([pa.array(f, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], ["f", "print"])

    return sketches(text)


def block_links(names: list[int], sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links that join what the pairs of at least that similarity join."""
    waiting, todo, links = list(range(1, len(names))), [0], []
    while waiting:
        if not todo:
            todo.append(waiting.pop(0))
            continue
        x = todo.pop()
        reached = set()
        for y in waiting:
            if near(sets[x], sets[y], similar):
                reached.add(y)
        links += [(names[x], names[y]) for y in sorted(reached)]
        todo += sorted(reached)
        waiting = [y for y in waiting if y not in reached]
    return links


def near(one: np.ndarray, other: np.ndarray, similar: float) -> bool:
    """Whether what two sorted sets share is at least `similar` of all they hold."""
    small, large = sorted((len(one), len(other)))
    if small < similar * large:
        return False
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared >= similar * (small + large - shared)


def linked_sets(prints: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similar: float) -> DataFrame:
    """(node, component): the smallest linked set of every set that has a link, from a frame (f, print) of different sets.

    `texts` adds `t`, a text of every set, to a frame with the sets' `f`.
    """
    width = _width(prints)
    blocks = components(simhash_links.near_sets(prints))
    blocks = blocks.select("component", F.col("node").alias("f"))
    blocks = stored(blocks.union(blocks.select("component", "component")).distinct())
    sized = blocks.join(blocks.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    small = sized.where(F.col("n") <= BLOCK_SETS).select("component", "f")
    moved = texts(small).repartition(width, "component").sortWithinPartitions("component", "f")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, sets = None, [], []
        for batch in slices(batches):
            found: list[tuple[int, int]] = []
            for component, f, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if component != block:
                    found += block_links(names, sets, similar)
                    block, names, sets = component, [], []
                names.append(f)
                sets.append(shingles_of(t, words))
            yield _edges(found)
        yield _edges(block_links(names, sets, similar))

    links = stored(moved.mapInArrow(link, "a long, b long"))
    large = stored(sized.where(F.col("n") > BLOCK_SETS).select("f"))
    if not large.isEmpty():
        links = links.union(_large_block_links(large, texts, words, similar))
    return components(links)


def _width(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _large_block_links(large: DataFrame, texts: Callable, words: int, similar: float) -> DataFrame:
    """Links (a, b) of the sets `f` in `large`: to the smallest of their bands, then by tiles."""

    @arrow_udf("array<long>")
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices_by_size(batches):
            yield pa.array([shingles_of(t.as_py(), words).view(np.int64) for t in part], pa.list_(pa.int64()))

    @arrow_udf("array<long>")
    def bands(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(batches):
            yield pa.array([bands_of(s.values.to_numpy(zero_copy_only=False).view(np.uint64)) for s in part], pa.list_(pa.int64()))

    sets = stored(texts(large).select("f", numbers("t").alias("s")))
    each = stored(sets.select("f", F.explode(bands("s")).alias("band")))
    least = each.groupBy("band").agg(F.min("f").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = stored(each.join(least, "band").where("f <> m").select("f", "m").distinct())
    parts = stars.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    dealt = stars.join(parts, "m").select("f", "m", F.expr("xxhash64(m, pmod(xxhash64(f), parts))").alias("g"))
    pivots = dealt.select("g", F.lit(0).alias("side"), F.col("m").alias("f"), F.col("m").alias("c")).distinct()
    first = _tile_links(pivots.union(dealt.select("g", F.lit(1), "f", "f")), sets, similar)

    joined = components(first).withColumnRenamed("node", "f")
    rest = stored(each.join(joined, "f", "left").select("band", "f", F.coalesce("component", "f").alias("c")))
    still = rest.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    rest = stored(rest.join(still, "band", "left_semi"))
    counts = rest.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.where(F.col("n") <= TILE).groupBy("band").agg(F.sum("n").alias("others"))
    whole = F.when(F.col("n") > TILE, F.col("c"))  # the component a tile is of; null where it holds several
    tiles = F.ceil(F.when(F.col("n") > TILE, F.col("n")).otherwise(F.col("others")) / TILE)
    placed = rest.join(counts, ["band", "c"]).join(mixed, "band", "left").select(
        "band", "f", "c", whole.alias("whole"), F.xxhash64(whole, F.pmod(F.xxhash64("f"), tiles)).alias("tile"))
    placed = stored(placed)
    kinds = placed.select("band", "whole", "tile").distinct()
    pairs = kinds.select("band", F.col("whole").alias("w"), F.col("tile").alias("u")).join(kinds, "band").where(
        "u <= tile AND NOT coalesce(w = whole, false)")
    pairs = pairs.select("band", "u", F.col("tile").alias("v"), F.xxhash64("band", "u", "tile").alias("g"))
    held = pairs.withColumn("tile", F.col("u")).join(placed, ["band", "tile"]).select("g", F.lit(0).alias("side"), "f", "c")
    passing = pairs.withColumn("tile", F.col("v")).join(placed, ["band", "tile"]).select(
        "g", F.when(F.col("u") == F.col("v"), 2).otherwise(1).alias("side"), "f", "c")
    return joined.select(F.col("f").alias("a"), F.col("component").alias("b")).union(_tile_links(held.union(passing), sets, similar))


def _tile_links(rows: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links of sets held (side 0) with sets passing (side 1; 2 if the held ones pass) in every group `g`.

    Rows: g, side, f, c; equal `c` are joined already and not compared. A task holds one group's side 0 and reads the rest.
    """
    moved = rows.join(sets, "f").select("g", "side", "f", "c", "s")
    moved = moved.repartition(_width(rows), "g").sortWithinPartitions("g", "side")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in slices(batches):
            found = []
            g, side, f, c = (batch.column(i).to_pylist() for i in range(4))
            for i, s in enumerate(batch.column(4)):
                if g[i] != group:
                    group, held = g[i], []
                s = s.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if side[i] == 0:
                    held.append((f[i], c[i], s.copy()))
                else:
                    found += [(f[i], x) for x, own, other in held
                              if own != c[i] and (side[i] == 1 or x < f[i]) and near(s, other, similar)]
            yield _edges(found)

    return stored(moved.mapInArrow(link, "a long, b long").distinct())


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def one_of_each_similar(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, similar: float = 0.8) -> DataFrame:
    """The rows of `df` that stay when one document of every group of near-duplicates does, as `one_of_each` keeps them.

    Texts link if the shingles they share are at least `similar` of all their different ones; texts without words link.
    """

    def links(firsts: DataFrame, slim: DataFrame) -> DataFrame:
        prints = slim.groupBy("f").agg(F.first("print").alias("print"))
        return linked_sets(stored(prints), texts_of(firsts), words, similar)

    def texts_of(firsts: DataFrame) -> Callable[[DataFrame], DataFrame]:
        def texts(blocks: DataFrame) -> DataFrame:
            one = blocks.join(firsts, "f").select(*blocks.columns, F.col("least.k").alias("k"), F.col("least.h").alias("h"))
            given = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
            found = one.alias("one").join(given.alias("given"), F.expr("one.k <=> given.k AND one.h = given.h"))
            return found.select(*blocks.columns, "t").dropDuplicates(["f"])

        return texts

    made = sketch(F.col(text), words)
    return kept_rows(df, text, key, [made["f"].alias("f"), made["print"].alias("print")], links)
