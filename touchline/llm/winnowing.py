"""Winnowing: the smallest k-gram hash of every window, the rightmost of equal ones, with its position.

With k-grams of `k` code points and windows of `window` hashes, any passage of at least k + window - 1 code points that two
texts share leaves a common hash in both fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.llm.common import slices, text_of

K, WINDOW = 20, 30
ROWS_GIVEN = 256  # rows that a task gathers before it gives them on
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse among 64-bit numbers
MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-gram: differences of one running polynomial sum, scaled back to the gram's start and mixed."""
    up, down = _grown(len(codes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up, dtype=np.uint64)])
    h = (total[k:] - total[:-k]) * down[: len(codes) - k + 1]
    h ^= h >> np.uint64(31)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def _smaller(values: np.ndarray, places: np.ndarray, shift: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries i and i + shift the smaller, the right one if equal."""
    left, right = values[:count], values[shift:shift + count]
    take = right <= left
    return np.where(take, right, left), np.where(take, places[shift:shift + count], places[:count])


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint64, positions int32) in order of position. A text shorter than k is one gram; an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    h = rolling_hashes(codes, min(k, len(codes)))
    window = min(window, len(h))
    values, places, width = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * width <= window:
        values, places = _smaller(values, places, width, len(h) - 2 * width + 1)
        width *= 2
    if width < window:
        values, places = _smaller(values, places, window - width, len(h) - window + 1)
    new = np.concatenate([[True], places[1:] != places[:-1]])
    return values[new], places[new]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def as_text(hashes: np.ndarray) -> str:
    """Hashes as 16 hex digits each, comma-joined."""
    return hashes.astype(">u8").tobytes().hex(",", 8) if len(hashes) else ""


def fingerprints(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """struct<hashes: array<long>, positions: array<int>> of a text column; null is read as empty."""

    @arrow_udf("struct<hashes: array<long>, positions: array<int>>")
    def selected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            rows = [winnow(t.as_py() or "", k, window) for t in texts]
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(h) for h, _ in rows])]).astype(np.int32))
            none = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
            hashes = pa.array(np.concatenate([h for h, _ in rows or none]).view(np.int64))
            places = pa.array(np.concatenate([p for _, p in rows or none]))
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(cuts, hashes), pa.ListArray.from_arrays(cuts, places)], ["hashes", "positions"])

    return selected(text)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _ranges(df: DataFrame, key: str, parts: int) -> tuple[Column, dict[int, tuple[int, int | None]]]:
    """Range number of the key column, and of every range that has rows: the range before it and its first key.

    Ranges are cut at approximate quantiles of the keys, `parts` at most; nulls come first. Both results are bounded by
    `parts`. The range before the first is the last.
    """
    cuts = np.array(sorted(set(df.where(F.col(key).isNotNull()).approxQuantile(
        key, [i / parts for i in range(1, parts)], 0.2 / parts))), np.int64) if parts > 1 else np.zeros(0, np.int64)

    @arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        values = keys.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(np.where(known, np.searchsorted(cuts, values, "right"), 0).astype(np.int32))

    number = range_of(F.col(key).cast("long"))
    firsts = df.select(number.alias("r"), F.col(key).cast("long").alias("k")).groupBy("r").agg(
        F.min(F.struct("k")).alias("first")).orderBy("r").collect()
    order = [row.r for row in firsts]
    return number, {row.r: (order[i - 1], row.first.k) for i, row in enumerate(firsts)}


def compared_with_next(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose end comes from the next document by ascending key.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions. The document
    after the last is the first; a single document follows itself. Null keys come first, equal keys are ordered by the
    text's hash; null texts are empty. Rows move once, to ranges of keys that are sorted and read as streams; the first
    row of a range also goes to the range before it, so no task needs another's rows.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    number, ranges = _ranges(df, key, parts)
    schema = (f"k {dict(df.dtypes)[key]}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, positions array<int>")
    if not ranges:
        return spark.createDataFrame([], schema).withColumnRenamed("k", key)
    before = F.create_map(*[F.lit(x) for r, (b, _) in ranges.items() for x in (r, b)])
    first = F.create_map(*[x for r, (_, f) in ranges.items() for x in (F.lit(r), F.lit(f).cast("long"))])
    rows = df.select(F.col(key).alias("k"), text_of(text).alias("t"), number.alias("r"))
    rows = rows.withColumn("copies", F.when(
        F.element_at(first, F.col("r")).eqNullSafe(F.col("k").cast("long")),
        F.array(F.struct(F.col("r").alias("at"), F.lit(False).alias("guest")),
                F.struct(F.element_at(before, F.col("r")).alias("at"), F.lit(True).alias("guest"))))
        .otherwise(F.array(F.struct(F.col("r").alias("at"), F.lit(False).alias("guest")))))
    rows = rows.select("k", "t", F.inline("copies")).repartition(parts, "at").sortWithinPartitions(
        "at", "guest", F.col("k").asc_nulls_first(), F.xxhash64("t"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []

        def given() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], key_type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:5]],
                 *[pa.array(c, pa.float64()) for c in columns[5:7]], pa.array(columns[7], pa.list_(pa.int32()))],
                ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"])

        for batch in batches:
            key_type = batch.schema.field("k").type
            for key_, text_, at, guest in zip(*[batch.column(c) for c in ("k", "t", "at", "guest")]):
                now = text_.as_py()
                if last and last[2] == at.as_py() or not guest.as_py():
                    h, p = winnow(now, k, window)
                if last and last[2] == at.as_py():
                    changed = edited(last[1], now)
                    e, _ = winnow(changed, k, window)
                    out.append((last[0], len(last[1]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(),
                                as_text(last[3]), as_text(e), likeness(last[3], e), likeness(last[3], h), last[4]))
                last = None if guest.as_py() else (key_.as_py(), now, at.as_py(), h, p)
                if len(out) == ROWS_GIVEN:
                    yield given()
        if out:
            yield given()

    return rows.mapInArrow(follow, schema).withColumnRenamed("k", key)
