"""Referee profiles, pair effects against the rest, extremes and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numeric import ratio
from touchline.operators.ordered import top_rows
from touchline.operators.profiles import with_cards
from touchline.operators.reshape import team_rows, unseen


def with_bias(matches: DataFrame) -> DataFrame:
    """Cards per side, home minus away cards, cards per foul and per match."""
    m = with_cards(matches)
    total = F.col("h_cards") + F.col("a_cards")
    fouls = F.col("hf") + F.col("af")
    return m.withColumns({"cards": total, "bias": F.col("h_cards") - F.col("a_cards"),
                          "cards_per_foul": ratio(total, fouls), "reds": F.col("hr") + F.col("ar"),
                          "shot_efficiency_diff": ratio("hg", "hst") - ratio("ag", "ast")})


def profile(matches: DataFrame, groups: list[str], min_matches: int = 10) -> DataFrame:
    """Mean cards, home bias, strictness and reds per referee, with the z-score of the bias across referees."""
    p = with_bias(matches).groupBy(*groups, "referee").agg(
        F.count(F.lit(1)).alias("matches"), F.avg("cards").alias("mean_cards"), F.avg("bias").alias("mean_bias"),
        F.avg("cards_per_foul").alias("cards_per_foul"), F.avg("reds").alias("reds_per_match"))
    p = p.filter(F.col("matches") >= min_matches)
    z = p.groupBy(*groups).agg(F.avg("mean_bias").alias("_m"), F.stddev_samp("mean_bias").alias("_s"))
    out = p.join(z, groups) if groups else p.withColumns({
        "_m": p.agg(F.avg("mean_bias")).scalar(), "_s": p.agg(F.stddev_samp("mean_bias")).scalar()})
    out = out.withColumn("z_bias", ratio(F.col("mean_bias") - F.col("_m"), "_s")).drop("_m", "_s")
    return out.withColumn("outlier", F.abs("z_bias") > 2)


def season_series(matches: DataFrame, min_matches: int = 5, min_seasons: int = 2) -> DataFrame:
    """Season figures of referees with enough matches in enough seasons, on the full season axis."""
    m = with_bias(matches)
    s = m.groupBy("referee", "season").agg(F.count(F.lit(1)).alias("matches"), F.avg("cards").alias("mean_cards"),
                                           F.avg("bias").alias("mean_bias")).filter(F.col("matches") >= min_matches)
    good = s.groupBy("referee").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_seasons)
    span = m.agg(F.struct(F.min("season").alias("lo"), F.max("season").alias("hi"))).scalar()
    axis = good.withColumn("_s", span).select("referee", F.explode(F.sequence("_s.lo", "_s.hi")).alias("season"))
    return axis.join(s, ["referee", "season"], "left")


def pair_vs_rest(matches: DataFrame, value: tuple[str, str], min_with: int = 4, min_rest: int = 4) -> DataFrame:
    """Team mean under one referee against its mean under all others: team totals minus the pair's own part."""
    long = team_rows(with_bias(matches), ["league", "referee"], {"v": value})
    pair = long.groupBy("league", "referee", "team").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    team = pair.groupBy("league", "team").agg(F.sum("n").alias("_N"), F.sum("s").alias("_S"))
    out = pair.join(team, ["league", "team"])
    rest = F.col("_N") - F.col("n")
    out = out.filter((F.col("n") >= min_with) & (rest >= min_rest))
    return out.select("league", "referee", "team", "n", ratio("s", "n").alias("with_referee"),
                      ratio(F.col("_S") - F.col("s"), rest).alias("with_others")).withColumn(
        "difference", F.col("with_referee") - F.col("with_others"))


def both_ends(df: DataFrame, groups: list[str], value: str, tie: list[str], k: int) -> DataFrame:
    """The k lowest and k highest rows of each group, labelled."""
    low = top_rows(df, groups, [F.asc(value), *[F.asc(t) for t in tie]], k).withColumn("end", F.lit("low"))
    high = top_rows(df, groups, [F.desc(value), *[F.asc(t) for t in tie]], k).withColumn("end", F.lit("high"))
    return low.unionByName(high)


def extremes(matches: DataFrame, k: int = 6, threshold: int = 4) -> tuple[DataFrame, DataFrame]:
    """Most one-sided matches of each referee, and the team most often favoured in extreme ones."""
    m = with_bias(matches)
    rows = both_ends(m.select("referee", "match_id", "home", "away", "bias"), ["referee"], "bias", ["match_id"], k)
    rows = rows.filter(((F.col("end") == "low") & (F.col("bias") < 0)) | ((F.col("end") == "high") & (F.col("bias") > 0)))
    far = m.filter(F.abs("bias") >= threshold).withColumn(
        "favoured", F.when(F.col("bias") < 0, F.col("home")).otherwise(F.col("away")))
    times = far.groupBy("referee", "favoured").agg(F.count(F.lit(1)).alias("times"))
    top = times.groupBy("referee").agg(
        F.sum("times").alias("extreme_matches"), F.max("times").alias("favoured_times"),
        F.min_by("favoured", F.struct(-F.col("times"), "favoured")).alias("favoured"))
    return rows, top


def season_trend(matches: DataFrame) -> DataFrame:
    """Bias, cards and home advantage per season."""
    m = with_bias(matches)
    return m.groupBy("season").agg(
        F.count(F.lit(1)).alias("matches"), F.avg("bias").alias("mean_bias"), F.avg("cards").alias("mean_cards"),
        F.avg(F.col("hg") - F.col("ag")).alias("mean_goal_diff"),
        F.avg((F.col("hg") > F.col("ag")).cast("double")).alias("home_win_rate"))


def by_phase(matches: DataFrame) -> DataFrame:
    return with_bias(matches).groupBy("referee", "phase").agg(
        F.count(F.lit(1)).alias("matches"), F.avg("cards").alias("mean_cards"), F.avg("bias").alias("mean_bias"))


def largest_team_share(matches: DataFrame) -> DataFrame:
    """Largest share of one team among a referee's team appearances: a confounding check."""
    n = team_rows(matches, ["referee"], {}).groupBy("referee", "team").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("referee").agg(F.sum("n").alias("appearances"), ratio(F.max("n"), F.sum("n")).alias("max_share"),
                                    F.min_by("team", F.struct(-F.col("n"), "team")).alias("team"))


def new_names(matches: DataFrame, known: DataFrame) -> DataFrame:
    return unseen(matches.select("referee").filter("referee IS NOT NULL").distinct(), known, ["referee"])


def z_score(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Standard score with the sample deviation, from group sums joined back."""
    s = df.groupBy(*groups).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(s, groups).withColumn(out, ratio(F.col(value) - F.col("_m"), "_s")).drop("_m", "_s")


def neighbours(ranked: DataFrame, focus: DataFrame, groups: list[str], reach: int = 5) -> DataFrame:
    """Rows within `reach` ranks of each group's focus row (both frames carry `rank`)."""
    f = focus.select(*groups, F.col("rank").alias("_f"))
    return ranked.join(f, groups).filter(F.abs(F.col("rank") - F.col("_f")) <= reach).drop("_f")


def changes(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before; each key's history must be short (a career, a season)."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    return df.withColumn("changed", prev.isNotNull() & (prev != F.col(value)))
