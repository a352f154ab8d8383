"""Fantasy points from season totals, percentiles inside league, season and position, and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import add_all, pearson, ratio, zero_if_null
from touchline.functions.probability import blank_probability, expected_floor
from touchline.functions.text import lookup
from touchline.operators.ranking import percentile_in_group

# Points per event. A scheme is data; pass another one to score differently.
OFFENSIVE = {
    "start": 2, "substitute": 1, "goal": {"GK": 6, "DF": 6, "MF": 5, "FW": 4, "ND": 5}, "assist": 3,
    "yellow": -1, "red": -3, "missed_penalty": -2,
}
# Defensive points; conceded goals and saves are paid per two and per three within a match.
DEFENSIVE = {
    "clean_sheet": {"GK": 4, "DF": 4, "MF": 1, "FW": 0, "ND": 1},
    "conceded": {"GK": -1, "DF": -1, "MF": 0, "FW": 0, "ND": 0}, "goals_per_point": 2,
    "save": 1, "saves_per_point": 3, "penalty_saved": 5,
}
PEERS = ["league", "season", "main_position"]


def _by_position(values: dict) -> Column:
    return lookup("main_position", {k: float(v) for k, v in values.items()}, F.lit(float(values["ND"])))


def offensive_points(seasons: DataFrame, scheme: dict = OFFENSIVE) -> DataFrame:
    """Points by source, their total, and the total per matchday and per 90 minutes."""
    missed = F.greatest(F.col("pens_att") - F.col("pens_made"), F.lit(0.0))
    out = seasons.withColumns({
        "pts_appearance": scheme["start"] * F.col("games_starts")
        + scheme["substitute"] * (F.col("games") - F.col("games_starts")),
        "pts_goals": _by_position(scheme["goal"]) * F.col("goals"),
        "pts_assists": scheme["assist"] * F.col("assists"),
        "pts_cards": scheme["yellow"] * F.col("cards_yellow") + scheme["red"] * F.col("cards_red"),
        "pts_penalties": scheme["missed_penalty"] * missed})
    out = out.withColumn("pts_total", add_all(
        ["pts_appearance", "pts_goals", "pts_assists", "pts_cards", "pts_penalties"]))
    return out.withColumns({"pts_per_matchday": ratio("pts_total", "league_games"),
                            "pts_per90": F.when(F.col("minutes_90s") > 0, F.col("pts_total") / F.col("minutes_90s"))})


def estimated_clean_sheets(starts, nineties, conceded) -> Column:
    """Matches without a goal against while on the pitch, from season totals."""
    c = F.col(conceded) if isinstance(conceded, str) else conceded
    s = F.col(starts) if isinstance(starts, str) else starts
    return F.when(c.isNotNull(), s * blank_probability(nineties, c))


def defensive_points(scored: DataFrame, scheme: dict = DEFENSIVE) -> DataFrame:
    """Clean sheets, conceded goals, saves and saved penalties; `complete` says whether all inputs existed."""
    keeper = zero_if_null("gk_minutes") > 0
    games = F.when(keeper, F.col("gk_games")).otherwise(F.col("games"))
    conceded = F.when(keeper, F.col("gk_goals_against")).otherwise(F.col("on_goals_against"))
    out = scored.withColumns({"_gk": keeper, "_n": games, "_c": conceded})
    n, c = F.col("_n"), F.col("_c")
    rate = F.when(n > 0, c / n).otherwise(0.0)
    saves = F.when(n > 0, zero_if_null("gk_saves") / n).otherwise(0.0)
    out = out.withColumns({
        "clean_sheets": F.when(F.col("_gk"), F.col("gk_clean_sheets")).otherwise(
            estimated_clean_sheets("games_starts", "minutes_90s", "on_goals_against")),
        "_conceded_floor": expected_floor(rate, scheme["goals_per_point"]) * n,
        "_saves_floor": expected_floor(saves, scheme["saves_per_point"]) * n})
    out = out.withColumns({
        "pts_clean_sheets": _by_position(scheme["clean_sheet"]) * F.col("clean_sheets"),
        "pts_conceded": F.when(c.isNotNull(), _by_position(scheme["conceded"]) * F.col("_conceded_floor")),
        "pts_saves": F.when(F.col("_gk") & F.col("gk_saves").isNotNull(), scheme["save"] * F.col("_saves_floor")),
        "pts_penalties_saved": F.when(F.col("_gk"), scheme["penalty_saved"] * F.col("gk_pens_saved"))})
    out = out.withColumn("pts_defensive", add_all(
        ["pts_clean_sheets", "pts_conceded", "pts_saves", "pts_penalties_saved"]))
    have = (F.col("gk_clean_sheets").isNotNull() & F.col("gk_goals_against").isNotNull()
            & F.col("gk_saves").isNotNull() & F.col("gk_pens_saved").isNotNull())
    out = out.withColumns({
        "pts_complete": F.col("pts_total") + F.col("pts_defensive"),
        "complete": F.when(F.col("_gk"), have).otherwise(F.col("on_goals_against").isNotNull())})
    return out.withColumn("pts_complete_per_matchday", ratio("pts_complete", "league_games")).drop(
        "_gk", "_n", "_c", "_conceded_floor", "_saves_floor")


def peer_percentile(df: DataFrame, value: str, out: str, min_minutes: float = 900,
                    only: Column | None = None) -> DataFrame:
    """Percentile among players of the same league, season and position with enough minutes."""
    eligible = F.col("minutes") >= min_minutes
    return percentile_in_group(df, value, PEERS, eligible if only is None else eligible & only, out)


def complete_percentile(df: DataFrame, out: str = "pct_complete", min_minutes: float = 900) -> DataFrame:
    """Percentile of complete points per matchday, among complete rows only."""
    return peer_percentile(df, "pts_complete_per_matchday", out, min_minutes, F.col("complete"))


def consistency(df: DataFrame, pct: str, min_seasons: int = 4) -> DataFrame:
    """Career summary of a percentile: mean, range and sample deviation over eligible seasons."""
    d = df.filter(F.col(pct).isNotNull())
    out = d.groupBy("player_key").agg(
        F.min_by("player", F.struct("season_start", "league")).alias("player"),
        F.mode("main_position", deterministic=True).alias("position"), F.count(F.lit(1)).alias("seasons"),
        F.array_join(F.array_sort(F.collect_set("league")), " / ").alias("leagues"), F.avg(pct).alias("pct_mean"),
        F.min(pct).alias("pct_min"), F.max(pct).alias("pct_max"), F.stddev_samp(pct).alias("pct_sd"),
        F.min("season_start").alias("since"), F.max("season_start").alias("until"))
    return out.filter(F.col("seasons") >= min_seasons)


def clean_sheet_validation(seasons: DataFrame) -> DataFrame:
    """Estimated against real clean sheets of keepers per band of games, with a total row from the same pass."""
    gk = seasons.filter((zero_if_null("gk_games") > 0) & F.col("gk_clean_sheets").isNotNull()
                        & F.col("gk_goals_against").isNotNull())
    band = (F.when(F.col("gk_games") <= 5, "1-5").when(F.col("gk_games") <= 15, "6-15")
            .when(F.col("gk_games") <= 25, "16-25").when(F.col("gk_games") <= 60, "26+"))
    gk = gk.withColumns({"band": band, "estimated": estimated_clean_sheets(
        "gk_games_starts", F.col("gk_minutes") / 90.0, "gk_goals_against")})
    gk = gk.withColumn("error", F.col("estimated") - F.col("gk_clean_sheets"))
    out = gk.rollup("band").agg(
        F.grouping("band").alias("_g"), F.count(F.lit(1)).alias("keepers"), F.avg("gk_clean_sheets").alias("real"),
        F.avg("estimated").alias("estimated"), F.avg("error").alias("bias"), F.avg(F.abs("error")).alias("mae"),
        pearson("estimated", "gk_clean_sheets").alias("r"))
    return out.filter("_g = 1 OR band IS NOT NULL").withColumn(
        "band", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("band"))).drop("_g")


def points_by_position(scored: DataFrame, min_minutes: float = 1500) -> DataFrame:
    """Mean of every points source per position among complete starter seasons."""
    parts = ["pts_total", "pts_clean_sheets", "pts_conceded", "pts_saves", "pts_penalties_saved", "pts_complete"]
    return scored.filter(F.col("complete") & (F.col("minutes") >= min_minutes)).groupBy("main_position").agg(
        F.count(F.lit(1)).alias("seasons"), *[F.avg(zero_if_null(p)).alias(p) for p in parts])


def floor_comparison(scored: DataFrame) -> DataFrame:
    """Saves and conceded goals paid by dividing season totals against the per-match rule, keepers only."""
    gk = scored.filter((zero_if_null("gk_minutes") > 0) & (F.col("gk_games") > 0))
    return gk.groupBy("league").agg(
        F.count(F.lit(1)).alias("keepers"), F.avg(F.col("gk_saves") / 3).alias("saves_divided"),
        F.avg("pts_saves").alias("saves_per_match"), F.avg(-F.col("gk_goals_against") / 2).alias("conceded_divided"),
        F.avg("pts_conceded").alias("conceded_per_match"))
