"""Squads, keepers, year-on-year stability and the difficulty ladder of leagues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import pearson, per90, ratio, share, weighted_mean, zero_if_null
from touchline.operators.ordered import top_rows
from touchline.operators.ranking import concentration, rank_correlation
from touchline.session import settle, stored


def team_summary(rows: DataFrame, locals_by_league: dict[str, list[str]], keep_partial: bool = False) -> DataFrame:
    """One row per team-season: squad use, ages, origins, results from keepers, and dependence on the top scorer."""
    d = rows if keep_partial else rows.filter(~F.col("partial_season"))
    at_home = F.create_map(*[x for k, v in locals_by_league.items() for x in (
        F.lit(k), F.array(*[F.lit(c) for c in v]))])
    d = d.withColumn("_foreign", ~F.array_contains(F.try_element_at(at_home, F.col("league")), F.col("country")))
    keys = ["league", "season", "team_id"]
    known = F.when(F.col("country") != "UNK", F.col("minutes"))
    out = d.groupBy(*keys).agg(
        F.min("season_start").alias("season_start"), F.min("team").alias("team"),
        F.count_if(F.col("minutes") > 0).alias("players_used"), weighted_mean("age", "minutes").alias("weighted_age"),
        ratio(100 * F.sum(F.when(F.col("_foreign"), known).otherwise(0.0)), F.sum(known)).alias("foreign_pct"),
        share(F.col("age") <= 21, "minutes").alias("under21_pct"), F.sum("minutes").alias("minutes"),
        F.round(F.sum(zero_if_null("gk_minutes")) / 90).alias("games"),
        *[F.sum(zero_if_null(f"gk_{c}")).alias(c) for c in ("wins", "ties", "losses")],
        F.sum("goals").alias("goals"),
        F.max_by(F.struct("player", "goals"), F.struct("goals", -F.col("ranker"))).alias("_top"))
    reliable = (F.col("games") > 0) & (F.abs(F.col("wins") + F.col("ties") + F.col("losses") - F.col("games")) <= 1)
    out = out.withColumns({"reliable": reliable, "top_scorer": F.col("_top.player"), "top_goals": F.col("_top.goals")})
    out = out.withColumns({c: F.when(F.col("reliable"), F.col(c)) for c in ("wins", "ties", "losses")})
    out = out.withColumn("points", 3 * F.col("wins") + F.col("ties"))
    out = out.withColumns({"ppm": ratio("points", "games"), "dependence": ratio("top_goals", "goals")}).drop("_top")
    return out.join(concentration(d, keys, "minutes", 0.8, "players_80"), keys)


def season_trend(teams: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles over teams per league and season."""
    return teams.groupBy("league", "season_start").agg(*[
        F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))[i].alias(f"{c}_{q}")
        for c in columns for i, q in enumerate(("p25", "median", "p75"))])


def keeper_totals(seasons: DataFrame, keep_partial: bool = False) -> DataFrame:
    """League rates from summed counts: save %, conceded per match and clean-sheet %."""
    p = seasons.filter(F.col("gk_games").isNotNull())
    p = p if keep_partial else p.filter(~F.col("partial_season"))
    sums = ["gk_saves", "gk_shots_on_target_against", "gk_goals_against", "gk_clean_sheets", "gk_games"]
    t = p.groupBy("league", "season_start").agg(*[F.sum(c).alias(c) for c in sums])
    return t.withColumns({"save_pct": ratio(100 * F.col("gk_saves"), "gk_shots_on_target_against"),
                          "conceded_per_match": ratio("gk_goals_against", "gk_games"),
                          "clean_sheet_pct": ratio(100 * F.col("gk_clean_sheets"), "gk_games")})


def keeper_careers(seasons: DataFrame, min_minutes: float = 9000) -> DataFrame:
    """Keepers with enough minutes in a league, with rates over the whole career there."""
    p = seasons.filter(F.col("gk_games").isNotNull())
    c = p.groupBy("league", "player_key").agg(
        F.count_distinct("season").alias("seasons"), F.min("season_start").alias("since"),
        F.max("season_start").alias("until"), F.sum("gk_minutes").alias("minutes"), F.sum("gk_games").alias("games"),
        F.sum("gk_saves").alias("saves"), F.sum("gk_shots_on_target_against").alias("shots"),
        F.sum("gk_goals_against").alias("conceded"), F.sum("gk_clean_sheets").alias("clean_sheets"))
    return c.filter(F.col("minutes") >= min_minutes).withColumns({
        "save_pct": ratio(100 * F.col("saves"), "shots"),
        "clean_sheet_pct": ratio(100 * F.col("clean_sheets"), "games"), "conceded_per90": per90("conceded", "minutes")})


def next_season_pairs(df: DataFrame, keys: list[str], values: list[str], minutes: str, min_minutes: float) -> DataFrame:
    """Each player's season joined with the one after it, both with enough minutes."""
    x = df.filter(F.col(minutes) >= min_minutes).select(*keys, "season_start", *values)
    y = x.select(*keys, (F.col("season_start") - 1).alias("season_start"),
                 *[F.col(v).alias(f"{v}_next") for v in values])
    return x.join(y, [*keys, "season_start"])


def stability(df: DataFrame, groups: list[str], value: str, min_minutes: float = 1500,
              minutes: str = "minutes") -> DataFrame:
    """Correlation of a metric between consecutive seasons of the same player, NULL below three pairs."""
    pairs = next_season_pairs(df.filter(F.col(value).isNotNull()), [*groups, "player_key"], [value], minutes, min_minutes)
    return pairs.groupBy(*groups).agg(pearson(value, f"{value}_next", 3).alias("r"), F.count(F.lit(1)).alias("pairs"))


def mean_stability(df: DataFrame, over: str, groups: list[str], first: str, second: str, min_minutes: float = 1500) -> DataFrame:
    """Stability of two metrics per group as the mean over leagues, and in how many of them the second is the more stable.

    Leagues are never pooled: their levels differ, and a player who changes league would pair with himself.
    """
    by = [over, *groups]
    both = stability(df, by, first, min_minutes).select(*by, F.col("r").alias("_a")).join(
        stability(df, by, second, min_minutes).select(*by, F.col("r").alias("_b")), by, "full")
    return both.groupBy(*groups).agg(F.avg("_a").alias(f"stability_{first}"), F.avg("_b").alias(f"stability_{second}"),
                                     F.count_if(F.col("_b") > F.col("_a")).alias("rises_in"))


def minutes_coverage(teams: DataFrame) -> DataFrame:
    """Control per season: teams, median of their matches and the least share of a full team's minutes (990 a match)."""
    share_ = ratio("minutes", F.col("games") * 990)
    return teams.groupBy("season").agg(F.count(F.lit(1)).alias("teams"), F.percentile("games", F.lit(0.5)).alias("median_games"),
                                       F.min(share_).alias("least_coverage"))


def with_team_points(seasons: DataFrame, teams: DataFrame) -> DataFrame:
    """Points per match with the player minus the team's, for players with one team only."""
    t = teams.select("league", "season", F.col("team_id").alias("main_team_id"), F.col("ppm").alias("_ppm"))
    extra = F.when(F.col("n_teams") == 1, F.col("points_per_game") - F.col("_ppm"))
    return seasons.join(t, ["league", "season", "main_team_id"], "left").withColumn("ppm_extra", extra).drop("_ppm")


def best_fantasy_per_team(scored: DataFrame) -> DataFrame:
    """Top scorer in fantasy points of each team-season and his share of the team's points."""
    keys = ["league", "season_start", "main_team_id"]
    total = scored.groupBy(*keys).agg(F.sum("pts_total").alias("team_points"))
    narrow = scored.select(*keys, "player_key", "pts_total")
    best = top_rows(narrow, keys, [F.desc("pts_total"), F.asc("player_key")], 1).drop("rank")
    return best.join(total, keys).withColumn("team_share", ratio("pts_total", "team_points"))


def league_comparison(teams: DataFrame, seasons: DataFrame, min_minutes: float) -> DataFrame:
    """One row per league: panel size, rank correlations with points per match and stabilities."""
    teams = stored(teams.select("league", "season", "team_id", "ppm", "players_80", "dependence", "goals"))
    seasons = stored(seasons.select(
        "league", "season", "season_start", "player_key", "main_team_id", "n_teams", "main_position", "minutes", "points_per_game",
        "plus_minus_wowy", "goals_pens_per90", "gk_games", "gk_minutes", "gk_save_pct", "gk_clean_sheets_pct"))
    j = with_team_points(seasons, teams)
    size = seasons.groupBy("league").agg(F.count_distinct("season").alias("seasons"),
                                         F.count_distinct("player_key").alias("players"))
    out = size.join(teams.groupBy("league").agg(F.count_distinct("team_id").alias("teams")), "league")
    for name, c in (("rotation", "players_80"), ("dependence", "dependence"), ("goals", "goals")):
        rho = rank_correlation(teams, ["league"], c, "ppm").select("league", F.col("rho").alias(f"rho_{name}"))
        out = out.join(rho, "league", "left")
    keepers = j.filter(F.col("gk_games").isNotNull())
    for name, frame, value, minutes in (
            ("on_off", j, "plus_minus_wowy", "minutes"), ("ppm_extra", j, "ppm_extra", "minutes"),
            ("forwards", j.filter("main_position = 'FW'"), "goals_pens_per90", "minutes"),
            ("saves", keepers, "gk_save_pct", "gk_minutes"),
            ("clean_sheets", keepers, "gk_clean_sheets_pct", "gk_minutes")):
        r = stability(frame, ["league"], value, min_minutes, minutes)
        out = out.join(r.select("league", F.col("r").alias(f"stability_{name}")), "league", "left")
    return out


def position_comparison(scored: DataFrame, min_minutes: float = 1500) -> DataFrame:
    """League and position: mean points, defensive share and three stabilities, on complete rows."""
    keys = ["league", "main_position"]
    d = settle(scored.filter("complete"))
    t = d.filter(F.col("minutes") >= min_minutes)
    out = t.groupBy(*keys).agg(
        F.count_distinct("player_key").alias("players"), F.count(F.lit(1)).alias("seasons"),
        F.avg("pts_total").alias("pts_offensive"), F.avg("pts_defensive").alias("pts_defensive"),
        F.avg("pts_complete").alias("pts_complete"),
        ratio(100 * F.sum("pts_defensive"), F.sum("pts_complete")).alias("defensive_pct"),
        F.avg(ratio("clean_sheets", "games")).alias("clean_sheets_per_match"))
    for name, value in (("offensive", "pts_per_matchday"), ("complete", "pts_complete_per_matchday"),
                        ("percentile", "pct_complete")):
        r = stability(d, keys, value, min_minutes)
        extra = [F.col("pairs")] if name == "complete" else []
        out = out.join(r.select(*keys, F.col("r").alias(f"stability_{name}"), *extra), keys, "left")
    return out.withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def clean_sheet_origin(scored: DataFrame, min_minutes: float = 1500) -> DataFrame:
    """Stability of clean sheets per match for players who stayed and who changed club, by position."""
    d = scored.filter("complete").withColumn("rate", ratio("clean_sheets", "games")).filter("rate IS NOT NULL")
    pairs = next_season_pairs(d, ["player_key", "main_position"], ["rate", "main_team_id"], "minutes", min_minutes)
    stay = F.col("main_team_id") == F.col("main_team_id_next")
    out = pairs.groupBy("main_position").agg(
        pearson(F.when(stay, F.col("rate")), "rate_next", 3).alias("r_stayed"), F.count_if(stay).alias("n_stayed"),
        pearson(F.when(~stay, F.col("rate")), "rate_next", 3).alias("r_moved"), F.count_if(~stay).alias("n_moved"))
    return out.withColumn("drop", F.col("r_stayed") - F.col("r_moved"))


def transfer_pairs(scored: DataFrame, leagues: list[str], min_minutes: float) -> DataFrame:
    x = scored.filter(F.col("pct_complete").isNotNull() & F.col("league").isin(leagues))
    return next_season_pairs(x, ["player_key"], ["league", "main_team_id", "pct_complete"], "minutes", min_minutes)


def ladder_moves(scored: DataFrame, leagues: list[str], min_minutes: float = 1500) -> DataFrame:
    """League changes with the percentile expected from players who changed club inside their league, and the residual."""
    pairs = settle(transfer_pairs(scored, leagues, min_minutes))
    same = F.col("league") == F.col("league_next")
    control = pairs.filter(same & (F.col("main_team_id") != F.col("main_team_id_next")))
    line = control.agg(F.struct(F.regr_slope("pct_complete_next", "pct_complete").alias("slope"),
                                F.regr_intercept("pct_complete_next", "pct_complete").alias("cut"))).scalar()
    moves = pairs.filter(~same).withColumn("_line", line)
    moves = moves.withColumn("expected", F.col("_line.cut") + F.col("_line.slope") * F.col("pct_complete")).drop("_line")
    return moves.withColumn("residual", F.col("pct_complete_next") - F.col("expected"))


def _solve(cells: list, leagues: list[str]):
    k = len(leagues)
    at = {name: i for i, name in enumerate(leagues)}
    gram, right = np.zeros((k, k)), np.zeros(k)
    n, squares = 0.0, 0.0
    for origin, target, count, total, sq in cells:
        i, j = at[origin], at[target]
        gram[i, i] += count
        gram[j, j] += count
        gram[i, j] -= count
        gram[j, i] -= count
        right[i] += total
        right[j] -= total
        n += count
        squares += sq
    inverse = np.linalg.pinv(gram)
    level = inverse @ right
    left_over = squares - 2 * level @ right + level @ gram @ level
    error = np.sqrt(np.maximum(np.diag(inverse) * left_over / max(n - (k - 1), 1), 0))
    return level, error


def ladder_cells(moves: DataFrame) -> DataFrame:
    """Sufficient statistics per origin and destination league."""
    return moves.groupBy("league", "league_next").agg(
        F.count(F.lit(1)).alias("n"), F.sum("residual").alias("total"),
        F.sum(F.col("residual") * F.col("residual")).alias("squares"))


def ladder(moves: DataFrame, leagues: list[str]) -> DataFrame:
    """Difficulty of each league (mean zero, minimum norm) with standard error, arrivals and departures.

    Only leagues x leagues sums reach the driver; the list of leagues is given, so that is a fixed small table.
    """
    cells = [tuple(r) for r in ladder_cells(moves).collect()]
    level, error = _solve(cells, leagues)
    rows = [(name, float(level[i]), float(error[i]), sum(int(c[2]) for c in cells if c[1] == name),
             sum(int(c[2]) for c in cells if c[0] == name)) for i, name in enumerate(leagues)]
    return moves.sparkSession.createDataFrame(
        rows, "league string, difficulty double, se double, arrivals bigint, departures bigint")


def ladder_replicates(moves: DataFrame, leagues: list[str], replicates: int = 2000, seed: int = 11) -> DataFrame:
    """(replicate, league, difficulty) from resampled transfers.

    Per replicate and league pair only sums remain; each replicate's small system is solved in its own task.
    """
    from touchline.operators.inference import replicate_sums

    units = moves.select(F.xxhash64("player_key", "season_start", "league", "league_next").alias("_id"), "league", "league_next",
                         F.lit(1.0).alias("n"), F.col("residual").alias("total"))
    sums = replicate_sums(units, "_id", ["n", "total"], replicates, seed, ["league", "league_next"])

    def solve(pdf):
        cells = [(r.league, r.league_next, r.n, r.total, 0.0) for r in pdf.itertuples()]
        level, _ = _solve(cells, leagues)
        return pd.DataFrame({"replicate": pdf["replicate"].iloc[0], "league": leagues, "difficulty": level})

    return sums.groupBy("replicate").applyInPandas(solve, "replicate bigint, league string, difficulty double")


def ladder_bootstrap(moves: DataFrame, leagues: list[str], replicates: int = 2000, seed: int = 11) -> DataFrame:
    """95 % interval of every league's difficulty."""
    ends = F.percentile("difficulty", F.array(F.lit(0.025), F.lit(0.975)))
    return ladder_replicates(moves, leagues, replicates, seed).groupBy("league").agg(ends[0].alias("low"), ends[1].alias("high"))


def ladder_differences(moves: DataFrame, leagues: list[str], replicates: int = 2000, seed: int = 11) -> DataFrame:
    """95 % interval of the difference of every two leagues' difficulties, from the same replicates."""
    levels = settle(ladder_replicates(moves, leagues, replicates, seed))
    other = levels.select("replicate", F.col("league").alias("other"), F.col("difficulty").alias("_d"))
    both = levels.join(other, "replicate").filter("league < other").withColumn("difference", F.col("difficulty") - F.col("_d"))
    ends = F.percentile("difference", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return both.groupBy("league", "other").agg(ends[0].alias("low"), ends[1].alias("middle"), ends[2].alias("high"))


def regression_curve(pairs: DataFrame, bands: list[float]) -> DataFrame:
    """Next-season percentile by band of the starting percentile."""
    x = F.col("pct_complete")
    band = F.lit(None).cast("int")
    for i in range(len(bands) - 1):
        band = F.when((x > bands[i]) & (x <= bands[i + 1]), i).otherwise(band)
    return pairs.withColumn("band", band).filter("band IS NOT NULL").groupBy("band").agg(
        F.avg("pct_complete").alias("before"), F.avg("pct_complete_next").alias("after"), F.count(F.lit(1)).alias("n"))


def squad_quality(teams: DataFrame, scored: DataFrame) -> DataFrame:
    """Minutes-weighted squad percentile and number of top-fifth players per team-season, joined with its points."""
    squad = scored.filter("pct_complete IS NOT NULL").groupBy(
        "league", "season_start", F.col("main_team_id").alias("team_id")).agg(
        weighted_mean("pct_complete", "minutes").alias("squad_pct"),
        F.count_if(F.col("pct_complete") >= 80).alias("top_fifth"))
    return teams.filter("ppm IS NOT NULL").join(squad, ["league", "season_start", "team_id"])


def squad_vs_points(teams: DataFrame, scored: DataFrame) -> DataFrame:
    """Rank correlation of squad quality with points per match, per league."""
    m = settle(squad_quality(teams, scored).select("league", "squad_pct", "top_fifth", "ppm"))
    a = rank_correlation(m, ["league"], "squad_pct", "ppm", "rho_squad").withColumnRenamed("pairs", "team_seasons")
    b = rank_correlation(m, ["league"], "top_fifth", "ppm", "rho_top_fifth").drop("pairs")
    return a.join(b, "league")


def repeated_eleven(rows: DataFrame) -> DataFrame:
    """Share of a team-season's starts taken by its eleven most frequent starters."""
    keys = ["league", "season", "team_id"]
    narrow = rows.select(*keys, "player_key", "games_starts")
    top = top_rows(narrow, keys, [F.desc("games_starts"), F.asc("player_key")], 11)
    best = top.groupBy(*keys).agg(F.sum("games_starts").alias("eleven_starts"))
    total = rows.groupBy(*keys).agg(F.sum("games_starts").alias("starts"))
    return best.join(total, keys).withColumn("share", ratio("eleven_starts", "starts"))


def explorer_rows(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Player-team-season rows with the season percentile and the share of the team's minutes."""
    team = rows.groupBy("league", "season", "team_id").agg(F.sum("minutes").alias("_m"))
    pct = scored.select("player_key", "league", "season", "pct_complete")
    return rows.join(team, ["league", "season", "team_id"]).join(pct, ["player_key", "league", "season"], "left").select(
        "league", "season", "team_id", "player_key", "main_position", "minutes", "goals", "assists",
        ratio("minutes", "_m").alias("minutes_share"), "pct_complete")
