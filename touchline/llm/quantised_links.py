"""Near-duplicate vectors by tile products of 8-bit numbers with rigorous error bounds.

Equal vectors of a label are one representative. A representative's unit vector u is kept as u = s q + e with whole numbers
|q| <= 127, and the length of e is known. For two vectors the product of the whole numbers is exact, and the cosine differs
from it by at most |e1| (1 + |e2|) + |e2|. Pairs above the threshold by more than that are links, pairs below it by more are
none, and only those between are recomputed in double precision from the vectors themselves.

Representatives of a label are hashed into tiles of bounded size; a task holds one pair of tiles. It returns each row's
number of links and one link to the smallest row reachable inside the pair, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import components, stored

TILE = 1024  # representatives of a tile, in the mean
BROADCAST_LABELS = 10_000  # tile counts of at most so many labels go to every executor; more are joined by a shuffle
SLACK = 1e-9  # above the rounding of double precision in bounds and products
CHUNK = 65_536  # pairs recomputed at a time


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers float32, scale, length of the error) of the rows' unit vectors."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(units).max(axis=1) / 127
    whole = np.rint(units / scale[:, None])
    error = np.linalg.norm(units - whole * scale[:, None], axis=1)
    return whole.astype(np.float32), scale, error + SLACK


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a have a cosine of at least the threshold with which rows of b: exact by bounds, or recomputed."""
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    product = (qa @ qb.T).astype(np.float64) * sa[:, None] * sb  # sums of whole numbers below 2^24 are exact in float32
    bound = ea[:, None] * (1 + eb) + eb + SLACK
    link = product >= threshold + bound
    i, j = np.nonzero(~link & (product >= threshold - bound))
    for at in range(0, len(i), CHUNK):
        x, y = a[i[at:at + CHUNK]], b[j[at:at + CHUNK]]
        cosine = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        link[i[at:at + CHUNK], j[at:at + CHUNK]] = cosine >= threshold
    return link


def smallest_reachable(link: np.ndarray) -> np.ndarray:
    """Per row of a symmetric link matrix the first row reachable."""
    low = np.arange(len(link))
    while True:
        new = np.where(link, low[None, :], len(link)).min(axis=1, initial=len(link))
        new = np.minimum(low, new)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _tile_pair(threshold: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, second = key[-2:]
        rows = rows.sort_values(["node", "h1", "h2"], ignore_index=True)
        vectors = np.stack(rows["x"].to_numpy()).astype(np.float64)
        tile, copies = rows["tile"].to_numpy(), rows["m"].to_numpy()
        left, right = np.nonzero(tile == first)[0], np.nonzero(tile == second)[0]
        link = np.zeros((len(rows), len(rows)), bool)
        part = linked(vectors[left], vectors[right], threshold)
        link[np.ix_(left, right)] = part
        link[np.ix_(right, left)] = part.T
        np.fill_diagonal(link, False)
        has = link.any(axis=1)
        rows = rows.assign(n=link @ copies, root=rows["node"].to_numpy()[smallest_reachable(link)])
        return rows.loc[has, ["label", "h1", "h2", "node", "n", "root"]]

    return compare


def near_vectors(df: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component, kept) of every row of `df`.

    Rows link if their labels are equal and not null and their cosine is at least `threshold`. Vectors that are null, empty
    or zero, hold a component that is null or not finite, and rows with a null key link with nothing; vectors of different
    lengths don't link. Rows with equal keys are one node of the components. `kept` is whether a row's key is its component.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.col(label).isNotNull() & F.col(key).isNotNull() & F.coalesce(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), x.alias("x"), sound.alias("sound"))
    # a length that double precision can square, whatever the vector's; the direction is all that counts
    top = F.array_max(F.transform("x", F.abs))
    rows = rows.withColumn("x", F.when(F.col("sound"), F.transform("x", lambda v: v / top)))
    rows = stored(rows.select("id", "label", "sound", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2")))
    groups = stored(rows.where("sound").groupBy("label", "h1", "h2").agg(
        F.min("id").alias("node"), F.count(F.lit(1)).alias("m"), F.first("x").alias("x")))
    tiles = stored(groups.groupBy("label", F.size("x").alias("d")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")))
    small = F.broadcast(tiles) if tiles.count() <= BROADCAST_LABELS else tiles
    placed = groups.withColumn("d", F.size("x")).join(small, ["label", "d"]).withColumn(
        "tile", F.pmod(F.xxhash64("h1", "h2"), F.col("tiles")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "d", "h1", "h2", "node", "m", "x", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    kinds = dict(groups.dtypes)
    found = stored(paired.groupBy("label", "d", "i", "j").applyInPandas(
        _tile_pair(threshold), f"label {kinds['label']}, h1 long, h2 long, node {kinds['node']}, n long, root {kinds['node']}"))
    links = found.groupBy("label", "h1", "h2").agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = groups.drop("x").join(links, ["label", "h1", "h2"], "left").join(reached, "node", "left")
    named = stored(named.select("label", "h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                                F.coalesce("component", "node").alias("component")))
    out = rows.drop("x").join(named, ["label", "h1", "h2"], "left")
    component = F.when(F.col("sound"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.when(F.col("sound"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
