"""Hard negatives of anchor vectors, with candidates bounded along spanning trees of the anchors.

Vectors are whole numbers, floor(scale * x), and a score is an exact inner product. Anchors that lie near each other share a
group, and a group's anchors form a minimum spanning tree of their distances. For a child anchor c with parent p and any row
x, |c.x - p.x| <= |c - p| |x|: the parent's score, or the interval already known for it, plus or minus the edge's length times
the row's length bounds the child's score. Root anchors score all rows; at every other anchor only rows are scored whose
interval meets a window that is still open, and they pass exact scores on to the anchor's children. A window is open between
its ends, or from the last of the rows it already holds.

Two rounds use this scan: one finds every anchor's positives (the window is all scores), one its negatives (a window for each
positive). A task reads one group's trees and a strip of row tiles, so that a tile travels once for each group; what comes
back are a few rows for each anchor, window and strip.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored

GROUP = 512  # anchors of a tree at most
TILE = 4096  # rows scored at a time
STRIP = 8  # tiles that one task reads for a group, where there are groups and tiles enough
LONG = 2**63 - 1
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): rows in an order in which parents come first, each one's parent's place in it (-1: root), edge length.

    Prim's method on Euclidean distances, from the row nearest to the mean.
    """
    n = len(vectors)
    near = np.full(n, inf)
    origin = np.full(n, -1)
    place = np.empty(n, np.int64)
    order, parent = np.empty(n, np.int64), np.empty(n, np.int64)
    at = int(np.linalg.norm(vectors - vectors.mean(axis=0), axis=1).argmin())
    left = np.ones(n, bool)
    for step in range(n):
        order[step], parent[step], place[at], left[at] = at, origin[at], step, False
        distance = np.linalg.norm(vectors - vectors[at], axis=1)
        closer = left & (distance < near)
        near[closer], origin[closer] = distance[closer], step
        at = int(np.where(left, near, inf).argmin())
    edge = np.linalg.norm(vectors[order] - vectors[order[np.maximum(parent, 0)]], axis=1)
    return order, parent, np.where(parent < 0, 0.0, edge)


def dense(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of numbers as one float64 matrix; shorter rows end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the smallest type that holds its whole numbers."""
    top = np.abs(matrix).max(initial=0)
    return matrix.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64)


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    """Arrays by name, rows of matrices as lists, as bytes."""
    held = {name: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]) if x.ndim == 2 and x.shape[1] else
            pa.array(x if x.ndim == 1 else [[]] * len(x), None if x.ndim == 1 else pa.list_(pa.int16(), 0)) for name, x in columns.items()}
    batch = pa.record_batch(held)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(body).read_next_batch()
    return {name: x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), x.type.list_size) if pa.types.is_fixed_size_list(x.type)
            else x.to_numpy(zero_copy_only=False) for name, x in zip(batch.schema.names, batch.columns)}


def _wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


class Tree:
    """Anchors in tree order with their windows, and the best rows found so far in each of them."""

    def __init__(self, ids, labels, vectors, parent, edge, lows, highs, same: bool, keep: int):
        self.ids, self.labels, self.vectors, self.parent, self.edge = ids, labels, vectors.astype(np.float64), parent, edge
        self.lows, self.highs, self.same, self.keep = lows, highs, same, keep
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * lows.shape[1] for _ in ids]
        self.floors = lows.copy()
        self.scored = 0

    def read(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Take a tile of rows into account."""
        width = max(self.vectors.shape[1], vectors.shape[1])
        a, x = _wide(self.vectors, width), _wide(vectors.astype(np.float64), width)
        lengths = np.linalg.norm(x, axis=1)
        top = np.linalg.norm(a, axis=1).max(initial=0) * lengths.max(initial=0)
        exact = top < 2**52  # every partial sum of a product is a whole number that doubles hold
        if top < 2**23:
            a, x = a.astype(np.float32), x.astype(np.float32)
        low, high = np.empty((2, len(a), len(x)))
        for i, p in enumerate(self.parent):
            if p < 0 or not exact:
                meets = np.ones(len(x), bool)
            else:
                reach = self.edge[i] * (1 + 1e-12) * lengths + 1  # above the rounding of lengths, products and sums
                np.subtract(low[p], reach, out=low[i])
                np.add(high[p], reach, out=high[i])
                meets = np.zeros(len(x), bool)
                for k in range(self.lows.shape[1]):
                    meets |= (high[i] >= self.floors[i, k]) & (low[i] <= self.highs[i, k])
            fits = (labels == self.labels[i]) == self.same
            if self.same:
                fits &= ids != self.ids[i]
            at = np.flatnonzero(meets if p < 0 and exact else meets & fits)
            if not len(at):
                continue
            if exact:
                s = (x[at] @ a[i]).astype(np.float64)
                low[i, at] = high[i, at] = s
                s, at = s[fits[at]].astype(np.int64), at[fits[at]]
            else:  # beyond doubles: whole numbers of any size, held to what a long can say
                whole = [int(v) for v in a[i]]
                s = np.array([max(-LONG, min(LONG, sum(u * int(v) for u, v in zip(whole, row)))) for row in x[at]], np.int64)
            self.scored += len(at)
            for k in range(self.lows.shape[1]):
                inside = (s >= self.floors[i, k]) & (s <= self.highs[i, k])
                if inside.any():
                    self._take(i, k, s[inside], ids[at[inside]])

    def _take(self, i: int, k: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.best[i][k][0], scores]), np.concatenate([self.best[i][k][1], ids])
        first = np.lexsort((ids, -scores))[: self.keep]
        self.best[i][k] = scores[first], ids[first]
        if len(first) == self.keep:
            self.floors[i, k] = max(self.floors[i, k], scores[first[-1]])

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, window, score, row) of what every window holds."""
        for i, windows in enumerate(self.best):
            for k, (scores, ids) in enumerate(windows):
                yield np.full(len(ids), self.ids[i]), np.full(len(ids), k, np.int32), scores, ids


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    body = _packed({"id": rows["id"].to_numpy(), "label": rows["label"].to_numpy(), "q": _narrow(dense(rows["q"]))})
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([body], pa.binary())})


def _trees(low: int, high: int):
    """Anchors of a group as trees; `scores` are their positives' scores, which give the windows, or null: one window of all."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("label", "ascending"), ("side", "ascending"), ("id", "ascending")])
        bodies = []
        for at in range(0, len(rows), GROUP):
            some = rows.slice(at, GROUP)
            vectors = dense(some["q"])
            order, parent, edge = spanning_tree(vectors)
            scores = some["scores"].to_pylist()
            ends = [[(-inf, inf)] if s is None else [(-(-low * v // 100), high * v // 100) for v in s] for s in scores]
            ends = [e + [(inf, -inf)] * (max(map(len, ends)) - len(e)) for e in ends]  # windows that hold nothing
            lows, highs = np.array(ends, np.float64).reshape(len(ends), -1, 2).transpose(2, 0, 1)
            bodies.append(_packed({
                "id": some["id"].to_numpy()[order], "label": some["label"].to_numpy()[order], "q": _narrow(vectors[order]),
                "parent": parent, "edge": edge, "lows": lows[order], "highs": highs[order]}))
        group = key[0].as_py()
        return pa.table({"grp": pa.array([group] * len(bodies), pa.int32()), "part": pa.array(range(len(bodies)), pa.int32()),
                         "body": pa.array(bodies, pa.binary())})

    return pack


def _scan(same: bool, keep: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trees = None, []

        def given() -> Iterator[pa.RecordBatch]:
            for tree in trees:
                held = [np.concatenate(c) for c in zip(*tree.found())]
                if held and len(held[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["anchor", "k", "score", "id"])
            trees.clear()

        for batch in batches:
            for group, strip, kind, body in zip(*[batch.column(c) for c in ("grp", "strip", "kind", "body")]):
                if now != (group.as_py(), strip.as_py()):
                    yield from given()
                    now = (group.as_py(), strip.as_py())
                held = _unpacked(body.as_py())
                if kind.as_py() == 0:
                    lows, highs = held["lows"].reshape(len(held["id"]), -1), held["highs"].reshape(len(held["id"]), -1)
                    trees.append(Tree(held["id"], held["label"], held["q"], held["parent"], held["edge"], lows.copy(), highs, same, keep))
                else:
                    for tree in trees:
                        tree.read(held["id"], held["label"], held["q"])
        yield from given()

    return scan


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The first `keep` rows of every anchor's window, by score, then smaller id, with their rank."""
    order = Window.partitionBy("anchor", "k").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that `anchor` selects.

    Components are read as double and become floor(scale * x), held to the range of a long; scores are exact sums of their
    products, held likewise. An anchor's positives are the first rows of its own label with another key; the negatives of a
    positive the first rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.
    First are higher scores, then smaller keys.

    Rows with a null key, label or vector, or with a component that is null or not finite (before or after scaling), take no
    part. Shorter vectors are read as if zeros followed, empty ones score 0. Repeated rows, and rows that share a key, each
    count as candidates; an anchor's key stands for the smallest of its rows by label and vector. Anchors without a positive,
    and positives without a negative, give no row; neither does an empty table. Keys and labels are whole numbers. Other
    columns, whatever their names, are not looked at.
    """
    kinds = dict(df.dtypes)
    if {kinds[key], kinds[label]} - WHOLE:
        raise TypeError("keys and labels are whole numbers")
    spark = df.sparkSession
    x = F.transform(F.col(vector), lambda v: v.cast("double") * scale)
    sound = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    q = F.transform(x, lambda v: F.floor(v).cast("double"))
    rows = stored(df.where(sound).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), q.alias("q"), anchor.alias("anchor")))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    groups, tiles = max(1, ceil(size.anchors / GROUP)), max(1, ceil(size.rows / TILE))
    cores = spark.sparkContext.defaultParallelism
    strips = min(tiles, max(ceil(tiles / STRIP), ceil(2 * cores / groups)))

    # the side of a random plane: anchors of a label that lie near each other come near each other in order
    side = F.aggregate(F.transform("q", lambda v, i: F.when(F.pmod(F.xxhash64(i), F.lit(2)) == 0, v).otherwise(-v)), F.lit(0.0), lambda s, v: s + v)
    anchors = rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")
    anchors = anchors.withColumn("side", side).repartitionByRange(groups, "label", "side", "id")
    anchors = stored(anchors.withColumn("grp", F.spark_partition_id()))
    last = anchors.agg(F.max("grp")).first()[0]
    packs = stored(rows.select("id", "label", "q", F.pmod(F.monotonically_increasing_id(), F.lit(tiles)).cast("int").alias("part"))
                   .groupBy("part").applyInArrow(_tile, "part int, body binary"))
    placed = packs.select(F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("grp"), (F.col("part") % strips).alias("strip"),
                          F.lit(1).alias("kind"), "part", "body")

    def scanned(held: DataFrame, same: bool, keep: int) -> DataFrame:
        trees = held.groupBy("grp").applyInArrow(_trees(low, high), "grp int, part int, body binary")
        trees = trees.select("grp", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), F.lit(0).alias("kind"), "part", "body")
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)
        dealt = trees.union(placed).repartition(width, "grp", "strip").sortWithinPartitions("grp", "strip", "kind", "part")
        return _best(dealt.mapInArrow(_scan(same, keep), "anchor long, k int, score long, id long"), keep)

    near = stored(scanned(anchors.withColumn("scores", F.lit(None).cast("array<long>")), True, positives).select("anchor", "rank", "score", "id"))
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("w")).select(
        F.col("anchor").alias("id"), F.col("w.score").alias("scores"))
    far = scanned(anchors.join(windows, "id"), False, negatives).select("anchor", (F.col("k") + 1).alias("of"), "rank", "score", "id")
    pairs = near.select("anchor", F.col("rank").alias("of"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    return pairs.join(far, ["anchor", "of"]).select(
        F.col("anchor").cast(kinds[key]).alias("anchor_id"), F.col("positive").cast(kinds[key]).alias("positive_id"), "rank",
        F.col("id").cast(kinds[key]).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
