"""Match-to-team rows, deduplication, axes and one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def team_rows(matches: DataFrame, keep: list[str], mirrored: dict[str, tuple[str, str]],
              home: str = "home", away: str = "away") -> DataFrame:
    """Two rows per match in one pass: team, rival, side, and each statistic from that team's view.

    `mirrored` maps an output name to its (home column, away column); the away row swaps them.
    """
    def side(own, other, label, at):
        return F.struct(F.col(own).alias("team"), F.col(other).alias("rival"), F.lit(label).alias("side"),
                        *[F.col(pair[at]).alias(name) for name, pair in mirrored.items()])

    rows = F.explode(F.array(side(home, away, "H", 0), side(away, home, "A", 1))).alias("_t")
    return matches.select(*keep, rows).select(*keep, "_t.*")


def first_of_content(df: DataFrame, ignore: list[str], order: str) -> DataFrame:
    """Drop later copies of rows with equal content; ids and row numbers are not content.

    The kept row is the one with the lowest `order`, found by a combining aggregate.
    """
    content = [c for c in df.columns if c not in ignore]
    kept = [c for c in ignore if c != order]
    best = df.groupBy(*content).agg(F.min(F.struct(order, *kept)).alias("_k"))
    return best.select(*content, "_k.*").select(*df.columns)


def total_row(df: DataFrame, group: str, aggregates: list[Column], label: str = "ALL") -> DataFrame:
    """Grouped rows plus one total row from the same pass."""
    out = df.rollup(group).agg(F.grouping(group).alias("_g"), *aggregates)
    return out.withColumn(group, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(group))).drop("_g")


def fill_axis(df: DataFrame, keys: list[str], axis: str, low: int, high: int) -> DataFrame:
    """One row per key and axis value between two bounds, absent ones with NULL measures."""
    frame = df.select(*keys).distinct().withColumn(axis, F.explode(F.sequence(F.lit(low), F.lit(high))))
    return frame.join(df, [*keys, axis], "left")


def one_hot(df: DataFrame, column: str, levels: list, prefix: str) -> DataFrame:
    """0/1 columns for all but the first level."""
    return df.select("*", *[F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(f"{prefix}_{v}")
                            for v in levels[1:]])


def unseen(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known yet."""
    return df.join(known.select(*keys), keys, "left_anti")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables that do not pair off, as multisets."""
    a = left.exceptAll(right).withColumn("only_in", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))


def repetition(df: DataFrame, content: list[str], order: str, out: str = "rep") -> DataFrame:
    """Number equal rows 0, 1, ... so that repeats pair one to one."""
    w = Window.partitionBy(*content).orderBy(order)
    return df.withColumn(out, F.row_number().over(w) - 1)


def align_by_content(rows: DataFrame, page: DataFrame, content: list[str], position: str,
                     same: list[str], ids: list[str]) -> DataFrame:
    """Give each row the ids of its page row: first by equal content, then by equal position with equal counts.

    `position` numbers both sides. Rows left without a partner have NULL ids and `matched_by` 'none'.
    """
    a = repetition(rows, content, position)
    b = repetition(page, content, position)
    exact = a.join(b.select(*content, "rep", *ids, F.col(position).alias("_used")),
                   [*content, "rep"], "left")
    done = exact.filter(F.col("_used").isNotNull())
    rest = exact.filter(F.col("_used").isNull()).select(*rows.columns)
    free = page.join(done.select(F.col("_used").alias(position)), position, "left_anti")
    near = rest.join(free.select(position, *same, *ids), [position, *same], "left")
    label = F.when(F.col(ids[0]).isNotNull(), "position").otherwise("none")
    return (done.select(*rows.columns, *ids).withColumn("matched_by", F.lit("content"))
            .unionByName(near.select(*rows.columns, *ids).withColumn("matched_by", label)))
