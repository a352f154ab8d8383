"""SimHash near-duplicates: fingerprints of word shingles, linked by equality of one-wildcard segment variants.

To find all fingerprints at `bits` or fewer differing bits, 64 bits are cut into ceil((bits + 1) / 2) segments: one of them
then differs by at most one bit. Every segment is indexed once per bit with that bit blanked, so two fingerprints whose
segment differs in at most one place share a key. Candidates meet by equality of keys and are verified over all 64 bits.

Only distinct fingerprints are indexed, and only they move: once, to the tasks of their keys, where buckets are read as a
sorted stream and candidates verified over all 64 bits. What leaves a bucket is not its pairs but links enough to join what
they join, at most one per member of a large bucket.

Sets of shingles that are similar rather than almost equal differ in far more bits: by a similarity of 0.8, in 15 of 100. For
them `near_sets` has the same index over fingerprints of WIDE words: SEGMENTS segments of twice HALF bits, one bit blanked. As
a segment with at most one differing bit has an equal half, a fingerprint moves to both halves of every segment, and the task of
a half blanks the bits of the other one. Candidates are verified over CHECKED words. The first FIRST segments are read by
themselves; what their links join is one to all others, and nothing in it is compared again. A task joins what it links and gives
on one row for each member but the smallest, so that a group's rows grow with its size, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.llm.common import components, own_name, slices, stored

SEED = 42
BLOCK = 65_536  # shingle hashes expanded to bits at a time
NEIGHBOURS = 8  # buckets larger than this and one are searched instead of compared pair by pair
WIDE = 16  # words of a wide fingerprint
SEGMENTS, HALF = 56, 9  # sets at 0.8 share a one-wildcard segment but for a chance of 0.000001, 4 shingles of 5 but for 0.0007
FIRST = 4  # segments whose links are followed before the others are read
HOPS = 2  # steps they are followed for
CHECKED, APART = 3, 56  # words of it that verify a candidate, and the bits that may differ in them
WIDE_NEIGHBOURS = 512
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint_of(text: str | None, words: int) -> int:
    """Signed 64-bit fingerprint: bit i is set if it is in over half the XXH64 of the `words`-word shingles, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by one space; a text of fewer words
    is one shingle; a text without words has fingerprint 0.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()  # both ASCII only on bytes
    if not found:
        return 0
    if len(found) <= words:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(found), SEED), "big", signed=True)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1].tolist()
    ends = ends[words - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big", signed=True)


def wide_fingerprint_of(hashes: np.ndarray) -> np.ndarray:
    """WIDE words of a set of XXH64 values, none for an empty set: a bit is set if it is in over half of their mixed products."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 255):  # counts of so many fit a byte
        x = hashes[at:at + 255, None] * FACTORS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64)


def fingerprint(text: Column, words: int = 4) -> Column:
    """Fingerprint (long) of a text column; null is read as empty."""

    @arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array([fingerprint_of(t.as_py(), words) for t in texts], pa.int64())

    return prints(text)


def as_hex(fingerprints: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprints)), 16, "0")


def _bounds(bits: int) -> list[tuple[int, int]]:
    """Segments as (first bit, end): as few as leave one with at most one differing bit."""
    count = (bits + 2) // 2
    cuts = [64 * i // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def variants(prints: DataFrame, bits: int) -> DataFrame:
    """(key, f): a frame of distinct fingerprints `f` with the hashes of all their segment variants, one per blanked bit."""
    masks = [((1 << end) - (1 << first)) & ~(1 << b) for first, end in _bounds(bits) for b in range(first, end)]
    signed = F.array(*[F.lit(m - (m >> 63 << 64)).cast("long") for m in masks])
    each = prints.select("f", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    return each.select(F.xxhash64("b", F.col("f").bitwiseAND(signed[F.col("b")])).alias("key"), "f")


def bucket_links(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a bucket's fingerprints join, from arrays ordered by key; every bucket must be whole."""
    left, right = bucket_pairs(keys, prints, bits)
    return prints[left], prints[right]


def bucket_pairs(keys: np.ndarray, prints: np.ndarray, bits: int, neighbours: int = NEIGHBOURS,
                 own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links that join what a bucket's fingerprints (of one word, or a row of words) join.

    Buckets of at most `neighbours` + 1 are compared at every distance in the order, all at once. A larger one is searched:
    each member reached is compared with those not reached yet, so one dense group costs little more than its size.
    Equal `own` are joined already and not compared.
    """
    own = np.arange(len(keys)) if own is None else own
    starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
    sizes = np.diff(starts)
    left, right = [], []
    few = sizes[sizes <= neighbours + 1]
    small = np.repeat(sizes <= neighbours + 1, sizes)
    met = np.zeros(len(keys), bool)
    if few.max(initial=1) > NEIGHBOURS + 1:  # members linked to the first of their bucket need not be compared with each other
        first = np.repeat(starts[:-1], sizes)
        met = small & ((own == own[first]) | (_differing(prints, prints[first]) <= bits))
        others = np.nonzero(met & (first != np.arange(len(keys))))[0]
        left.append(first[others])
        right.append(others)
    for shift in range(1, few.max(initial=1)):
        same = np.nonzero((keys[shift:] == keys[:-shift]) & small[shift:] & (own[shift:] != own[:-shift])
                          & ~(met[shift:] & met[:-shift]))[0]
        same = same[_differing(prints[same], prints[same + shift]) <= bits]
        left.append(same)
        right.append(same + shift)
    for i in np.nonzero(sizes > neighbours + 1)[0]:
        waiting = np.arange(starts[i], starts[i + 1])
        todo: list[np.ndarray] = []
        while len(waiting):
            if todo:
                block = todo.pop()
            else:
                block, waiting = waiting[:1], waiting[1:]
            for x in block:
                near = (own[waiting] == own[x]) | (_differing(prints[waiting], prints[x]) <= bits)
                if near.any():
                    found, waiting = waiting[near], waiting[~near]
                    left.append(found)
                    right.append(np.full(len(found), x))
                    todo.append(found)
                if not len(waiting):
                    break
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(a ^ b)
    return counts if counts.ndim == 1 else counts.sum(axis=1, dtype=np.uint16)


def linked_prints(prints: DataFrame, bits: int) -> DataFrame:
    """(node, component): the smallest linked fingerprint of every fingerprint that has a link, from a frame of distinct `f`."""
    spark = prints.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keyed = variants(prints.select("f").repartition(width, "f"), bits).repartition(width, "key").sortWithinPartitions("key")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            values = np.concatenate([values, batch.column("f").to_numpy().view(np.uint64)])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last bucket may go on in the next batch
            if whole:
                yield _edges(*bucket_links(keys[:whole], values[:whole], bits))
                keys, values = keys[whole:], values[whole:]
        if len(keys):
            yield _edges(*bucket_links(keys, values, bits))

    return components(stored(keyed.mapInArrow(link, "a long, b long").distinct()))


def halves_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of wide fingerprints: the numbers of its segments' halves, place included, and the half beside each."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1)[:, :2 * HALF * SEGMENTS]
    values = bits.reshape(len(prints), 2 * SEGMENTS, HALF) @ (1 << np.arange(HALF))
    beside = values.reshape(-1, SEGMENTS, 2)[:, :, ::-1].reshape(len(prints), -1)
    return (np.arange(2 * SEGMENTS) << HALF) + values, beside


def smallest_joined(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The smallest of the numbers below `count` that links (a, b) join each of them with."""
    least = np.arange(count)
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    return least


def half_links(half: np.ndarray, beside: np.ndarray, prints: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that join what rows join with equal halves whose other halves differ in at most one bit, verified.

    Rows of equal `own`, numbers from 0, are joined already.
    """
    own = np.arange(len(half)) if own is None else own
    left, right = [], []
    for blank in range(HALF):
        keys = half << HALF | beside & ~(1 << blank)
        order = np.argsort(keys, kind="stable")
        a, b = bucket_pairs(keys[order], prints[order], APART, WIDE_NEIGHBOURS, own[order])
        left.append(order[a])
        right.append(order[b])
        own = smallest_joined(own[left[-1]], own[right[-1]], int(own.max(initial=-1)) + 1)[own]
    return np.concatenate(left), np.concatenate(right)


def near_sets(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all candidates, from a frame (f, print) of different sets and their wide fingerprints."""
    prints = prints.where(F.size("print") > 0)
    first = _segment_links(prints.select("f", "print", F.col("f").alias("c")), 0, FIRST)
    least = first.groupBy("a").agg(F.min("b").alias("c"))
    for _ in range(HOPS):  # the smallest neighbour's smallest neighbour, and so on
        least = stored(least.join(least.select(F.col("a").alias("c"), F.col("c").alias("next")), "c", "left").select(
            "a", F.coalesce("next", "c").alias("c")))
    named = prints.join(least, F.col("f") == F.col("a"), "left").select("f", "print", F.coalesce("c", "f").alias("c"))
    return first.union(_segment_links(named, FIRST, SEGMENTS))


def _segment_links(prints: DataFrame, start: int, end: int) -> DataFrame:
    """Links (a, b) between different `c` that join what candidates by segments `start` to `end` do, from a frame (f, print, c).

    Equal `c` are joined already. No task gives a `c` more than one link for every half it reads of it.
    """
    spark = prints.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    checks = [f"p{i}" for i in range(CHECKED)]
    copies = 2 * (end - start)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wide = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE)
            half, beside = (x[:, 2 * start:2 * end].ravel().astype(np.int32) for x in halves_of(wide))
            columns = [half, beside, np.repeat(batch.column(2).to_numpy(), copies),
                       *(np.repeat(wide[:, i].view(np.int64), copies) for i in range(CHECKED))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["half", "beside", "c", *checks])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            half, beside, c, *words = (rows.column(i).to_numpy() for i in range(3 + CHECKED))
            names, own = np.unique(c, return_inverse=True)
            a, b = half_links(half.astype(np.int64), beside.astype(np.int64), np.stack(words, axis=1).view(np.uint64), own)
            least = smallest_joined(own[a], own[b], len(names))
            return _edges(*(x[least != np.arange(len(names))] for x in (names, names[least])))

        for batch in batches:
            half = batch.column(0).to_numpy()
            whole = int(np.searchsorted(half, half[-1])) if len(half) else 0  # the last half may go on in the next batch
            if whole or held and len(half) and held[-1].column(0)[-1].as_py() != half[0]:
                held.append(batch[:whole])
                yield found()
                held = []
            if len(half):
                held.append(batch[whole:])
        if held:
            yield found()

    types = "half int, beside int, c long, " + ", ".join(f"{c} long" for c in checks)
    rows = prints.select("f", "print", "c").repartition(width, "f").mapInArrow(dealt, types)
    rows = rows.repartition(width, "half").sortWithinPartitions("half")
    return stored(rows.mapInArrow(link, "a long, b long").distinct())


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([a, b], axis=1).view(np.int64), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, bits: int = 4) -> DataFrame:
    """(key, fingerprint long, component): every row's fingerprint and the smallest key reachable by links, itself included.

    Texts link if their fingerprints differ in at most `bits` bits; equal fingerprints link, those of texts without words
    too. Null texts count as empty. Null keys are never a component's name unless all of its keys are null. Repeated rows
    come out as often as they went in. An empty frame gives an empty frame.
    """
    rows = stored(df.select(F.col(key).alias("k"), fingerprint(F.col(text), words).alias("f")))
    firsts = stored(rows.groupBy("f").agg(F.min("k").alias("least")))
    links = linked_prints(firsts, bits)
    named = firsts.join(links, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("component", "f").alias("c"))
    names = named.groupBy("c").agg(F.min("least").alias("component"))
    named = stored(named.join(names, "c").select("f", "component"))
    return rows.join(named, "f").select(F.col("k").alias(key), F.col("f").alias("fingerprint"), "component")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of `df` that stay when one document of every group of near-duplicates does: the one with the smallest key.

    Rows are told apart by key and text. Where the kept key has several different texts in its group, all of one text
    (the smallest hash) stay once; rows with a null key stay only if their group has no other. Columns and their order are
    those of `df`.
    """
    return kept_rows(df, text, key, [fingerprint(F.col(text), words).alias("f")],
                     lambda firsts, slim: linked_prints(firsts, bits))


def kept_rows(df: DataFrame, text: str, key: str, prints: list[Column], links: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The rows that `one_of_each` keeps, for any fingerprint `f`, the first of `prints`.

    `links` gives (node, component) of fingerprints from the frame of distinct `f` and that of all rows (k, h, f and the
    other `prints`), h being the text's hash.
    """
    k, h = (own_name(df, s) for s in ("key", "hash"))
    slim = stored(df.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), *prints))
    firsts = stored(slim.groupBy("f").agg(F.min(F.struct(F.col("k").isNull().alias("z"), "k", "h")).alias("least")))
    named = firsts.join(links(firsts, slim), F.col("f") == F.col("node"), "left")
    keep = named.groupBy(F.coalesce("component", "f").alias("c")).agg(F.min(F.struct("least", "f")).alias("best"))
    keep = stored(keep.select(F.col("best.least.k").alias(k), F.col("best.least.h").alias(h)))
    kept = df.join(keep, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)))
    if not slim.groupBy("k", "h").count().where("count > 1").isEmpty():  # only rows that are there twice need a second shuffle
        kept = kept.dropDuplicates([k, h])
    return kept.select(*[df[c] for c in df.columns])
