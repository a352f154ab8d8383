"""Line deduplication by overlapping windows of three lines.

Every window of consecutive lines is hashed (128 bits); where a window occurs again, in another document or later in its
own, the lines that the later occurrences cover are removed, as merged ranges of positions. The first occurrence, by key,
text hash and position, keeps its lines. Blank lines are in no window and go only inside a removed range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import own_name, stored

WIDTH = 3


def _windows(text: Column, width: int) -> Column:
    """array<struct<first, last, h1, h2>>: positions of a window's first and last line, and its hashes."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("i"), F.rtrim(line).alias("line"))),
                     lambda x: F.trim(x["line"]) != "")

    def window(x: Column, i: Column, found: Column) -> Column:
        part = F.slice(found, i + 1, width)
        held = F.transform(part, lambda y: y["line"])
        return F.struct(x["i"].alias("first"), part[width - 1]["i"].alias("last"), F.xxhash64(held).alias("h1"),
                        F.xxhash64(F.lit(1), held).alias("h2"))

    whole = F.transform(F.array(lines), lambda found: F.transform(
        F.slice(found, 1, F.greatest(F.size(found) - (width - 1), F.lit(0))), lambda x, i: window(x, i, found)))
    return whole[0]


def _merged(ranges: Column) -> Column:
    """Sorted ranges (a, b), merged where they overlap or meet."""
    kind = "array<struct<a:int,b:int>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(-2).alias("a"), F.lit(-2).alias("b"))

    def closed(s: Column) -> Column:
        return F.when(s["a"] >= 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        joins = x["a"] <= s["b"] + 1
        return F.struct(F.when(joins, s["done"]).otherwise(closed(s)).alias("done"),
                        F.when(joins, s["a"]).otherwise(x["a"]).alias("a"),
                        F.when(joins, F.greatest(s["b"], x["b"])).otherwise(x["b"]).alias("b"))

    return F.aggregate(ranges, zero, step, closed)


def covered_lines(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(k, h, ranges): key, text hash and merged ranges of removed line positions of every text that loses lines."""
    each = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.inline(_windows(F.col(text), width)))
    firsts = stored(each.groupBy("h1", "h2").agg(
        F.min(F.struct("k", "h", "first", "last")).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = F.col("k").eqNullSafe(F.col("origin.k")) & (F.col("h") == F.col("origin.h"))
    later = each.join(firsts, ["h1", "h2"]).where(~same | (F.col("first") != F.col("origin.first"))).select(
        "k", "h", F.when(same, F.greatest("first", F.col("origin.last") + 1)).otherwise(F.col("first")).alias("a"),
        F.col("last").alias("b")).where("a <= b")
    return later.groupBy("k", "h").agg(_merged(F.array_sort(F.collect_set(F.struct("a", "b")))).alias("ranges"))


def without_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, removed: str | None = None) -> DataFrame:
    """`df` with repeated windows removed from its text; all columns and rows are kept.

    A text all of whose lines go becomes empty; texts of fewer than `width` lines that aren't blank, and null ones, stay as
    they are. Within one document a window that overlaps its own first occurrence loses only the lines beyond it. Rows with
    equal key and text count as one document, so none of them loses lines to the other. `removed` names a column for the
    number of removed lines.
    """
    k, h, ranges = (own_name(df, s) for s in ("key", "hash", "ranges"))
    covered = stored(covered_lines(df, text, key, width)).select(F.col("k").alias(k), F.col("h").alias(h), F.col("ranges").alias(ranges))
    # one plan at every size: ranges grow with the texts, so they are never sent to all executors
    joined = df.join(covered.hint("merge"), F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.exists(
        F.col(ranges), lambda r: i.between(r["a"], r["b"]))), "\n")
    new = F.when(F.col(ranges).isNull(), F.col(text)).otherwise(kept)
    gone = F.coalesce(F.aggregate(ranges, F.lit(0), lambda s, r: s + r["b"] - r["a"] + 1), F.lit(0))
    columns = [new.alias(c) if c == text else F.col(c) for c in df.columns]
    return joined.select(*columns, *([gone.alias(removed)] if removed else []))
