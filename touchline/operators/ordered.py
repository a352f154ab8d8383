"""Ordered operators that stay balanced when one key holds a large part of the rows.

A plain window sorts all rows of a key in one task. Here a key's rows are numbered from per-day counts, cut into
chunks of bounded size, and windows run per chunk; a rolling window also sees the last rows of the previous chunk
and an expanding one starts from the totals of the chunks before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLLING_CHUNK = 4096
EXPANDING_CHUNK = 65536


def number_rows(df: DataFrame, keys: list[str], day: str, tie: str, out: str = "seq",
                max_gap_days: int | None = None, segment: str = "segment") -> DataFrame:
    """Number each key's rows by (day, tie) from 1.

    With `max_gap_days` a pause longer than that starts a new `segment`, in which numbering restarts.
    """
    by_key = Window.partitionBy(*keys).orderBy(day)
    days = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
    if max_gap_days is None:
        days = days.withColumn(segment, F.lit(0).cast("bigint"))
    else:
        days = days.withColumn("_prev", F.lag(day).over(by_key)).withColumn(
            segment,
            F.sum(F.when(F.datediff(F.col(day), F.col("_prev")) > max_gap_days, 1).otherwise(0))
            .over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        days = days.drop("_prev")
    before = Window.partitionBy(*keys, segment).orderBy(day).rowsBetween(
        Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, day).orderBy(tie)
    numbered = df.join(days, [*keys, day]).withColumn(
        out, (F.col("_before") + F.row_number().over(within)).cast("bigint")).drop("_before")
    return numbered.drop(segment) if max_gap_days is None else numbered


def _with_halo(df: DataFrame, seq: str, reach: int, chunk: int) -> DataFrame:
    """Put each row in its chunk and, near the end of a chunk, also in the next one."""
    home = F.floor((F.col(seq) - 1) / chunk)
    near_end = (F.col(seq) - 1) % chunk >= chunk - reach
    return df.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))


def rolling_before(df: DataFrame, keys: list[str], seq: str, columns: list[str], window: int,
                   min_count: int, suffix: str = "_prev", chunk: int = ROLLING_CHUNK) -> DataFrame:
    """Mean of the `window` rows before each row, NULL below `min_count` known values."""
    spread = _with_halo(df, seq, window, max(chunk, window))
    w = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(-window, -1)
    spread = spread.withColumns({
        c + suffix: F.when(F.count(c).over(w) >= min_count, F.avg(c).over(w)) for c in columns})
    return spread.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def expanding_before(df: DataFrame, keys: list[str], seq: str, columns: list[str], min_count: int,
                     suffix: str = "_prev", chunk: int = EXPANDING_CHUNK) -> DataFrame:
    """Mean of all rows before each row, NULL below `min_count` known values."""
    chunked = df.withColumn("_chunk", F.floor((F.col(seq) - 1) / chunk))
    sums = chunked.groupBy(*keys, "_chunk").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in columns],
        *[F.count(c).alias(f"_c_{c}") for c in columns])
    carried = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"{p}{c}").over(carried), F.lit(0)).alias(f"{p}{c}")
          for c in columns for p in ("_s_", "_c_")])
    w = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    means = {}
    for c in columns:
        n = F.col(f"_c_{c}") + F.count(c).over(w)
        means[c + suffix] = F.when(n >= min_count, (F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))) / n)
    out = chunked.join(sums, [*keys, "_chunk"]).withColumns(means)
    return out.drop("_chunk", *[f"{p}{c}" for c in columns for p in ("_s_", "_c_")])


def lead_row(df: DataFrame, keys: list[str], seq: str, columns: list[str], suffix: str = "_next",
             chunk: int = ROLLING_CHUNK) -> DataFrame:
    """Values of each key's following row, by shifted equality on the row number."""
    spread = df.withColumn("_home", F.floor((F.col(seq) - 1) / chunk))
    first = (F.col(seq) - 1) % chunk == 0
    spread = spread.withColumn("_chunk", F.explode(
        F.when(first & (F.col("_home") > 0), F.array(F.col("_home"), F.col("_home") - 1))
        .otherwise(F.array(F.col("_home")))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    spread = spread.withColumns({c + suffix: F.lead(c).over(w) for c in columns})
    return spread.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def totals_before_day(df: DataFrame, keys: list[str], day: str, sums: dict, ) -> DataFrame:
    """Per key and day: totals of all strictly earlier days (same-day rows are excluded).

    Rows are added up per day before the window, so a window holds days, not rows.
    """
    daily = df.groupBy(*keys, day).agg(*[e.alias(n) for n, e in sums.items()])
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(*keys, day, *[F.sum(n).over(w).alias(n) for n in sums])


def top_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """Best k rows per key; adds `rank`. `order` needs a unique last column.

    Spark cuts every key down to k rows before the shuffle (its group limit below a ranking filter), so a hot key is small
    where its rows meet.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def largest_magnitudes(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k rows per key whose value is furthest from zero, either way."""
    return top_rows(df, keys, [F.abs(value).desc(), F.asc(tie)], k)


def next_rows(df: DataFrame, keys: list[str], day: str, tie: str, after, k: int) -> DataFrame:
    """The first k rows per key after a day."""
    return top_rows(df.filter(F.col(day) > after), keys, [F.asc(day), F.asc(tie)], k)


def latest_rows(df: DataFrame, keys: list[str], day: str, tie: str, upto, k: int) -> DataFrame:
    """The last k rows per key up to a day, most recent first."""
    return top_rows(df.filter(F.col(day) <= upto), keys, [F.desc(day), F.desc(tie)], k)
