"""Toxicity by class-conditional Kneser-Ney models of words.

Toxic and ordinary labelled texts each give a bigram model: discounted bigram counts back off to the class's continuation
counts, and these to continuation counts that both classes share, so that an expression too rare to know gets nearly the
same probability from both. A text's score is a logistic function of its length-normalised log-likelihood differences,
calibrated on labelled texts kept out of the counts.

Counts cover every labelled text and are summed by Spark per pair of words, which have numbers of WORD_BITS bits. A text's
differences are sums of values of its words and pairs, and all but expressions seen more than DISCOUNT times have value zero.
The values are a stored table that grows with the input: up to SENT_KEYS rows are sent to every executor, a larger table is
joined with the texts' different keys by a shuffle. Both ways give the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.llm.common import own_name, slices, stored, text_of
from touchline.llm.fitting import Lookup, logistic, sigmoid

WORD_BITS = 62
PAIR_BITS = 20  # buckets in which sent keys are looked up
SENT_KEYS = 2_000_000
DISCOUNT = 2.0  # expressions seen at most so often are left to the backoff
EXCESS = 1.0  # a word whose log-likelihood difference is above this also counts by its excess
CALIBRATION_SHARE = 8  # one in so many labelled texts calibrates and is not counted
CALIBRATION_ROWS = 20_000  # at most so many of them are collected for the fit
BROADCAST_LABELS = 2_000_000  # labels of at most so many rows go to every executor; more are joined by a shuffle
TEXTS_COUNTED = 2048  # texts whose pairs a task sums up before it gives them on
PAIR_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed numbers of all words of the texts, and the offsets of each text in them. Words are runs of letters in lower case."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL]+")
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.dictionary_encode()
    numbers = np.array([xxhash.xxh3_64_intdigest(w.as_py().encode()) & (1 << WORD_BITS) - 1 for w in coded.dictionary], np.int64)
    return numbers[coded.indices.to_numpy()[full]] if len(numbers) else np.zeros(0, np.int64), offsets


def words_before(numbers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of the word before every word; the first word of a text follows number 0."""
    before = np.zeros(len(numbers), np.int64)
    before[1:] = numbers[:-1]
    before[offsets[:-1][offsets[:-1] < len(numbers)]] = 0
    return before


def pair_keys(before: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """64-bit key of words with the words before them. A word by itself has the key ~number."""
    return (before.astype(np.uint64) * PAIR_MIX + numbers.astype(np.uint64)).view(np.int64)


def pairs(numbers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Key of every word with the word before it; the first word of a text follows number 0."""
    return pair_keys(words_before(numbers, offsets), numbers)


def pair_cells(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * PAIR_MIX) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


@dataclass
class Model:
    """Values of words and pairs in the log-likelihood differences of toxic over ordinary models, and the calibration.

    A conditional probability is backoff(context) * (known(pair) + lower(word)), a lower one backoff * (known(word) +
    shared(word)): dividing a difference by the backoff masses makes an expression that neither class knows count zero.
    """

    table: DataFrame | None  # (key, whole, lower): a word's values, and what a pair adds to the whole of its word
    sent: Lookup | None  # the same, if it has at most SENT_KEYS rows
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    base: float

    def differences(self, texts: pa.Array) -> np.ndarray:
        """Per text: log-likelihood difference per word of the whole models and of the lower order alone, the sum of the
        latter's excess above EXCESS, and the number of words.

        Continuation counts are what copies of one text can't raise, so the excess is taken from the lower order.
        """
        numbers, offsets = word_numbers(texts)
        whole, lower = self.sent(~numbers).astype(float)
        whole = whole + self.sent(pairs(numbers, offsets))[0]
        total = np.cumsum([whole, lower, np.maximum(lower - EXCESS, 0)], axis=1)
        total = np.concatenate([np.zeros((3, 1)), total], axis=1)
        count = np.diff(offsets)
        sums = total[:, offsets[1:]] - total[:, offsets[:-1]]
        return np.vstack([sums[:2] / np.maximum(count, 1), sums[2:], count]).T

    def calibrated(self, d: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(d), self.base)
        x = (inputs(d) - self.centre) / self.scale
        return sigmoid(np.column_stack([np.ones(len(x)), x]) @ self.weights)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.calibrated(self.differences(texts))


def inputs(d: np.ndarray) -> np.ndarray:
    """Inputs of the calibration: differences per word, excess per word, logs of the excess and of the length."""
    return np.stack([d[:, 0], d[:, 1], d[:, 2] / np.maximum(d[:, 3], 1), np.log1p(d[:, 2]), np.log1p(d[:, 3])], axis=1)


def lower_orders(continuations: np.ndarray, mass: np.ndarray | None = None, total: float | None = None) -> np.ndarray:
    """Lower-order probabilities from continuation counts [2, words] over those both classes share, per backoff mass.

    They are scaled so that unknown words have equal values in both classes. Where the words are part of a vocabulary, `mass`
    [2, 1] and `total` are its sums.
    """
    both = continuations.sum(axis=0) + 1.0
    if mass is None:
        mass, total = np.minimum(continuations, DISCOUNT).sum(axis=1, keepdims=True), both.sum()
    return np.maximum(continuations - DISCOUNT, 0) / np.maximum(mass, 1) + both / total


def _numbers(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy().astype(float) for c in names])


def _counts(labelled: DataFrame, text: str, toxic: str) -> DataFrame:
    """(before, word, ordinary, toxic): occurrences of every pair of words per class, over all rows."""
    names = ["before", "word", "ordinary", "toxic"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS_COUNTED):
            numbers, offsets = word_numbers(batch.column("t"))
            before = words_before(numbers, offsets)
            is_toxic = np.repeat(batch.column("y").to_numpy() == 1, np.diff(offsets))
            found, first, place = np.unique(pair_keys(before, numbers), return_index=True, return_inverse=True)
            bad = np.bincount(place, is_toxic, len(found)).astype(np.int64)
            both = np.bincount(place, minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (before[first], numbers[first], both - bad, bad)], names)

    each = labelled.select(F.col(text).alias("t"), F.col(toxic).cast("int").alias("y")).mapInArrow(
        count, ", ".join(f"{n} long" for n in names))
    return each.groupBy("before", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _values(counts: DataFrame) -> DataFrame:
    """(key, whole, lower): values of all words and pairs that have any, from the pair counts by one aggregate and two joins."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, word = (batch.column(c).to_numpy() for c in ("before", "word"))
            n = np.stack([batch.column(c).to_numpy() for c in ("ordinary", "toxic")])
            known = np.nonzero((n > DISCOUNT).any(axis=0))[0]
            parts = [(np.zeros(len(known), np.int64), before[known], word[known], np.maximum(n[:, known] - int(DISCOUNT), 0))]
            for kind, ids, values in ((1, before, np.minimum(n, int(DISCOUNT))), (2, word, (n > 0).astype(np.int64))):
                found, place = np.unique(ids, return_inverse=True)
                sums = np.stack([np.bincount(place, v, len(found)).astype(np.int64) for v in values])
                parts.append((np.full(len(found), kind), found, np.zeros(len(found), np.int64), sums))
            kind, k, other, sums = (np.concatenate(x, axis=-1) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, k, other, *sums)], ["kind", "k", "other", "a", "b"])

    summed = stored(counts.mapInArrow(entries, "kind long, k long, other long, a long, b long").groupBy("kind", "k", "other").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")))
    words = summed.where("kind = 2").select(F.col("k").alias("word"), F.col("a").alias("wa"), F.col("b").alias("wb"))
    contexts = summed.where("kind = 1").select(F.col("k").alias("before"), F.col("a").alias("ca"), F.col("b").alias("cb"))
    held = words.agg(F.sum(F.least("wa", F.lit(DISCOUNT))), F.sum(F.least("wb", F.lit(DISCOUNT))), F.sum(F.col("wa") + F.col("wb") + 1)).first()
    mass, total = np.array([[float(held[0] or 0)], [float(held[1] or 0)]]), float(held[2] or 1)

    def out(key: np.ndarray, whole: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
        some = (whole != 0) | (lower != 0)
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(whole[some].astype(np.float32)),
                                           pa.array(lower[some].astype(np.float32))], ["key", "whole", "lower"])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower = lower_orders(_numbers(batch, "wa", "wb"), mass, total)
            change = np.log(lower[1] / lower[0])
            yield out(~batch.column("word").to_numpy(), change, change)

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower = lower_orders(_numbers(batch, "wa", "wb"), mass, total)
            whole = _numbers(batch, "a", "b") / np.maximum(_numbers(batch, "ca", "cb"), 1) + lower
            change = np.log(whole[1] / whole[0]) - np.log(lower[1] / lower[0])
            yield out(pair_keys(batch.column("before").to_numpy(), batch.column("word").to_numpy()), change, np.zeros(len(change)))

    known = summed.where("kind = 0").select(F.col("k").alias("before"), F.col("other").alias("word"), "a", "b")
    kind = "key long, whole float, lower float"
    return stored(words.mapInArrow(of_words, kind).union(known.join(contexts, "before").join(words, "word").mapInArrow(of_pairs, kind)))


def held_out(key: Column) -> Column:
    """Whether labels of a row are never learnt from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic") -> Model:
    """Counts and calibration from the labelled documents that are not held out.

    Labels that are null are no labels; of several for one key the highest counts. One in CALIBRATION_SHARE documents, by
    a hash of its key, calibrates instead of being counted, CALIBRATION_ROWS of them at most. Where a class is missing
    every score is the share of toxic labels.
    """
    k = own_name(documents, "key")
    marks = labels.where(F.col(toxic).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias(k)).agg(
        F.max(F.col(toxic).cast("int")).alias("y"))
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(CALIBRATION_SHARE))
    rows = documents.select(F.col(key), text_of(text).alias("t")).join(marks, F.col(key) == F.col(k))
    table = _values(_counts(rows.where(spread != 0), "t", "y"))
    sent = None
    if table.count() <= SENT_KEYS:
        values = table.toArrow()
        sent = Lookup(values.column("key").to_numpy(), np.stack([values.column(c).to_numpy() for c in ("whole", "lower")]),
                      pair_cells, 1 << PAIR_BITS)
    model = Model(table, sent, np.zeros(0), np.zeros(0), np.zeros(0), 0.0)
    sample = rows.where(spread == 0).withColumn("o", F.xxhash64(F.col(key), F.lit(1))).orderBy("o", "t").limit(CALIBRATION_ROWS)
    found = measured(sample.select("t", "y"), model, "t", "d").select("d.*", "y").toArrow()
    y = found.column("y").to_numpy() if len(found) else np.zeros(0)
    if 0 < y.sum() < len(y):
        x = inputs(np.stack([found.column(c).to_numpy() for c in "abcd"], axis=1))
        model.centre, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        model.weights = logistic((x - model.centre) / model.scale, y)
    else:
        model.base = float(rows.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0])
    return model


def measured(df: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """`df` with the struct `name` of the differences a, b, c and d of its texts; null is read as empty."""
    if model.sent is not None:
        inner = df.sparkSession.sparkContext.broadcast(replace(model, table=None))

        @arrow_udf("a double, b double, c double, d double")
        def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in slices(batches):
                yield pa.StructArray.from_arrays([pa.array(c) for c in inner.value.differences(texts).T], list("abcd"))

        return df.withColumn(name, measure(F.col(text)))
    h1, h2 = own_name(df, "h1"), own_name(df, "h2")
    hashed = df.withColumns({h1: F.xxhash64(text_of(text)), h2: F.xxhash64(F.lit(1), text_of(text))})

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            numbers, offsets = word_numbers(batch.column("t"))
            count = np.diff(offsets)
            row = np.tile(np.repeat(np.arange(len(count)), count), 2)
            keys = np.concatenate([~numbers, pairs(numbers, offsets)])
            order = np.lexsort((keys, row))
            row, keys = row[order], keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
            at = np.nonzero(new)[0]
            first = np.ones(len(at), bool)  # of its text: carries the number of words, and one for the text
            first[1:] = row[at[1:]] != row[at[:-1]]
            names = [batch.column(c).to_numpy()[row[at]] for c in ("h1", "h2")]
            sizes = np.diff(np.append(at, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*names, keys[at], sizes, np.where(first, count[row[at]], 0),
                                                                    first.astype(np.int64))], ["h1", "h2", "key", "n", "words", "texts"])

    each = hashed.select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), text_of(text).alias("t")).mapInArrow(
        keys_of, "h1 long, h2 long, key long, n long, words long, texts long")
    lower = F.coalesce("lower", F.lit(0.0))
    sums = each.join(model.table.hint("merge"), "key", "left").groupBy(F.col("h1").alias(h1), F.col("h2").alias(h2)).agg(
        F.sum(F.col("n") * F.coalesce("whole", F.lit(0.0))).alias("a"), F.sum(F.col("n") * lower).alias("b"),
        F.sum(F.col("n") * F.greatest(lower - EXCESS, F.lit(0.0))).alias("c"), F.sum("words").alias("d"), F.sum("texts").alias("m"))
    # repeated texts bring their keys as often as they are there
    made = F.struct((F.col("a") / F.col("d")).alias("a"), (F.col("b") / F.col("d")).alias("b"), (F.col("c") / F.col("m")).alias("c"),
                    (F.col("d") / F.col("m")).alias("d"))
    none = F.struct(*[F.lit(0.0).alias(c) for c in "abcd"])
    joined = hashed.join(sums.select(h1, h2, made.alias(name)), [h1, h2], "left")
    return joined.withColumn(name, F.coalesce(name, none)).select(*df.columns, name)


def with_score(df: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """`df` with the column `name` of scores (0 to 1) of its texts; null is read as empty. Any size of model will do."""
    if model.sent is not None:
        return df.withColumn(name, score(df.sparkSession, model, F.col(text)))
    d, bare = own_name(df, "d"), replace(model, table=None)

    @arrow_udf("double")
    def calibrated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in batches:
            yield pa.array(bare.calibrated(np.stack([found.field(c).to_numpy(zero_copy_only=False) for c in "abcd"], axis=1)))

    return measured(df, model, text, d).withColumn(name, calibrated(F.col(d))).drop(d)


def score(spark, model: Model, text: Column) -> Column:
    """Score (0 to 1) of a text column by a model of at most SENT_KEYS values; null is read as empty."""
    sent = spark.sparkContext.broadcast(replace(model, table=None))

    @arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array(sent.value.scores(texts))

    return scored(text)
