"""URL filters: host and path rules, and a character language-model ratio for what no rule decides.

Urls that rules accept and reject train two variable-order Markov models of their characters: an order's counts are
interpolated with the next lower order by Witten and Bell's weights (the number of different followers), down to a uniform
choice of bytes. A url's log-likelihood difference per character is calibrated on ruled urls kept out of the counts.

Counts cover all ruled urls and are summed by Spark per context and follower. For scoring they are folded into 2^CELL_BITS
cells by a hash, which bounds the model that is sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices, stored
from touchline.llm.fitting import logistic

ORDER = 4
CELL_BITS = 19
CALIBRATION_SHARE = 5  # one in so many ruled urls calibrates and is not counted
CALIBRATION_ROWS = 20_000  # at most so many of them are collected for the fit
END = 1  # byte that ends a url; urls hold no such character, and the padding before them is 0
MIX = np.uint64(0x9E3779B97F4A7C15)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path(url: Column) -> Column:
    """From the host's end up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: Sequence[str]) -> Column:
    """The longest rule (host and start of a path, as one string) that fits, or null: the host is the rule's or below it."""

    def fits(rule: str) -> Column:
        name, start = rule.split("/", 1)
        return ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(f"/{start}")

    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in sorted(rules, key=len, reverse=True)], F.lit(None).cast("string"))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys [order, place] of every byte with the 0..ORDER bytes before it, and the places' offsets per text.

    A key holds order, context and follower, so it is exact.
    """
    parts, offsets = [], [0]
    for t in texts:
        raw = (t.as_py() or "").encode("utf-8", "replace").replace(b"\0", b" ").replace(b"\1", b" ")
        parts.append(b"\0" * ORDER + raw + bytes([END]))
        offsets.append(offsets[-1] + len(raw) + 1)
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    lengths = np.diff(offsets)
    starts = np.array(offsets[:-1]) + ORDER * np.arange(1, len(lengths) + 1)
    place = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1]) if len(lengths) else np.zeros(0, np.int64)
    keys, context = [], np.zeros(len(place), np.int64)
    for order in range(ORDER + 1):
        if order:
            context |= data[place - order] << 8 * (order - 1)
        keys.append((order << 8 * ORDER | context) << 8 | data[place])
    return np.stack(keys), np.array(offsets)


def cells(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


@dataclass
class Model:
    """Counts per class (0 accepted, 1 rejected): of context and follower, of context, and of different followers."""

    joint: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    weights: np.ndarray

    def differences(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihood under the rejected model less that under the accepted one, per character."""
        keys, offsets = grams(texts)
        logs = []
        for c in (0, 1):
            p = np.full(keys.shape[1], 1 / 256)
            for row in keys:
                before = cells(row >> 8)
                kinds = np.maximum(self.kinds[c][before], 1)
                p = (self.joint[c][cells(row)] + kinds * p) / (self.total[c][before] + kinds)
            logs.append(np.concatenate([[0.0], np.cumsum(np.log(p))]))
        change = logs[1] - logs[0]
        return (change[offsets[1:]] - change[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def _fold(counts: DataFrame) -> list[np.ndarray]:
    """Tables of the model from the counts per key; CELL_BITS bounds the rows that are collected."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            n = [batch.column(c).to_numpy().astype(float) for c in ("accepted", "rejected")]
            at = np.concatenate([cells(keys), (1 << CELL_BITS) + cells(keys >> 8), (2 << CELL_BITS) + cells(keys >> 8)])
            found, place = np.unique(at, return_inverse=True)
            sums = [np.bincount(place, np.concatenate([x, x, x > 0]), len(found)) for x in n]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[0]), pa.array(sums[1])], ["cell", "a", "b"])

    summed = counts.mapInArrow(places, "cell long, a double, b double").groupBy("cell").agg(
        F.sum("a").cast("float").alias("a"), F.sum("b").cast("float").alias("b")).toArrow()
    flat = np.zeros((2, 3 << CELL_BITS), np.float32)
    at = summed.column("cell").to_numpy()
    flat[0, at], flat[1, at] = summed.column("a").to_numpy(), summed.column("b").to_numpy()
    return np.split(flat, 3, axis=1)


def fit(ruled: DataFrame) -> Model | None:
    """Model of a frame (t, rejected boolean); None if either class has no url to count or to calibrate on."""
    ruled = ruled.withColumn("part", F.pmod(F.xxhash64("t"), F.lit(CALIBRATION_SHARE)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16_384):
            keys, offsets = grams(batch.column("t"))
            bad = np.repeat(batch.column("rejected").to_numpy(zero_copy_only=False), np.diff(offsets))
            found, place = np.unique(keys.ravel(), return_inverse=True)
            rejected = np.bincount(place.ravel(), np.tile(bad, len(keys)), len(found)).astype(np.int64)
            both = np.bincount(place.ravel(), minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(both - rejected), pa.array(rejected)],
                                             ["key", "accepted", "rejected"])

    counts = ruled.where("part <> 0").select("t", "rejected").mapInArrow(count, "key long, accepted long, rejected long")
    joint, total, kinds = _fold(counts.groupBy("key").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    model = Model(joint, total, kinds, np.zeros(2))
    sample = ruled.where("part = 0").orderBy(F.xxhash64("t", F.lit(1)), "t").limit(CALIBRATION_ROWS)
    found = differences(sample.select("t", "rejected"), model).toArrow()
    y = found.column("rejected").to_numpy().astype(float) if len(found) else np.zeros(0)
    if not (0 < y.sum() < len(y) and joint[0].any() and joint[1].any()):
        return None
    model.weights = logistic(found.column("difference").to_numpy()[:, None], y)
    return model


def differences(df: DataFrame, model: Model, text: str = "t") -> DataFrame:
    """`df` with `difference`, the log-likelihood difference per character of its column `text`."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def difference(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches, 4096):
            yield pa.array(sent.value.differences(texts))

    return df.withColumn("difference", difference(F.col(text)))


def judge(df: DataFrame, rules: dict[str, str], url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """`keep` columns, host, path, rule, verdict, difference and chance of every row of `df`.

    `rules` maps rules to allow or block. Where none fits, the models decide: block where the calibrated chance of
    rejection is one half or more. Where the ruled urls lack a class, such urls are allowed, with null difference.
    Null urls, and those without ://, have empty host and path and are judged as empty text.
    """
    rows = df.select(*keep, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule = rule_of(F.col("host"), F.col("path"), list(rules))
    decided = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()])
    rows = rows.withColumn("rule", rule).withColumn("ruled", decided).withColumn("t", F.concat("host", "path"))
    rows = stored(rows)
    model = fit(rows.where("ruled is not null").select("t", (F.col("ruled") == "block").alias("rejected")))
    if model is None:
        rows = rows.withColumns({"difference": F.lit(None).cast("double"), "chance": F.lit(0.0)})
    else:
        constant, slope = map(float, model.weights)
        rows = differences(rows, model).withColumn("chance", 1 / (1 + F.exp(-(F.lit(constant) + slope * F.col("difference")))))
    method = F.when(F.col("chance") >= 0.5, "block").otherwise("allow")
    return rows.select(*keep, "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "difference", "chance")
