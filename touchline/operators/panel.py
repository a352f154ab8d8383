"""Player panel: audit, cleaning, identity and season totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.functions.numeric import per90, ratio, season_start, weighted_mean
from touchline.operators.reshape import first_of_content
from touchline.session import stored

COUNTS = ["games", "games_starts", "minutes", "goals", "assists", "pens_made", "pens_att", "cards_yellow",
          "cards_red"]
PLAYINGTIME_SUMS = ["games_complete", "games_subs", "unused_subs", "on_goals_for", "on_goals_against"]
KEEPER_SUMS = ["gk_games", "gk_games_starts", "gk_minutes", "gk_goals_against", "gk_shots_on_target_against",
               "gk_saves", "gk_wins", "gk_ties", "gk_losses", "gk_clean_sheets", "gk_pens_att", "gk_pens_allowed",
               "gk_pens_saved", "gk_pens_missed"]
WEIGHTED = {"points_per_game": "games", "plus_minus_wowy": "minutes"}
NOT_CONTENT = ["ranker", "player_id", "team_id"]
SEASON_KEY = ["player_key", "league", "season"]


def typed(raw: DataFrame) -> DataFrame:
    """Minutes with thousands separators as numbers; nothing else is changed before the audit."""
    return raw.withColumn("minutes", text.thousands("minutes"))


def derived(df: DataFrame) -> DataFrame:
    """Counts and per-90 rates that follow from the raw counts; no rate without minutes."""
    df = df.withColumns({"goals_assists": F.col("goals") + F.col("assists"),
                         "goals_pens": F.col("goals") - F.col("pens_made"),
                         "minutes_90s": F.col("minutes") / 90.0})
    return df.withColumns({
        "goals_per90": per90("goals", "minutes"), "assists_per90": per90("assists", "minutes"),
        "goals_assists_per90": per90("goals_assists", "minutes"),
        "goals_pens_per90": per90("goals_pens", "minutes"),
        "goals_assists_pens_per90": per90(F.col("goals_pens") + F.col("assists"), "minutes")})


def player_key(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Canonical player id: source id with aliases joined, or the name key for all rows if any id is missing."""
    by_id = text.lookup("player_id", aliases) if aliases else F.col("player_id")
    by_name = text.name_key("player", "birth_year", "nationality")
    missing = df.agg(F.max(F.col("player_id").isNull().cast("int"))).scalar()
    return df.withColumn("player_key", F.when(missing == 1, by_name).otherwise(by_id))


def league_norms(df: DataFrame) -> DataFrame:
    """Most games anyone played per league-season, and whether that is below 60 % of the league's norm."""
    top = df.groupBy("league", "season").agg(F.max("games").alias("league_games"))
    norm = F.max("league_games").over(Window.partitionBy("league"))
    return top.withColumn("partial_season", F.col("league_games") < 0.6 * norm)


def clean(raw: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """One row per player-team-season with repaired counts and working columns."""
    df = stored(first_of_content(typed(raw), NOT_CONTENT, "ranker"))  # read for its rows, its ids and its league norms
    rebuilt = F.round(F.coalesce(F.col("minutes_90s"), F.lit(0.0)) * 90)
    df = df.withColumn("minutes", F.coalesce("minutes", rebuilt))
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in COUNTS})
    df = derived(df.withColumn("pens_att", F.greatest("pens_att", "pens_made")))
    df = player_key(df, aliases or {})
    df = df.withColumns({
        "provisional_id": ~text.is_hex_id("player_key"), "country": text.last_word("nationality"),
        "main_position": text.first_listed("position"), "season_start": season_start("season"),
        "age": text.age_years("age")})
    return df.join(stored(league_norms(df)), ["league", "season"])  # a table whose size Spark knows: few rows are broadcast


def with_extras(cleaned: DataFrame, playingtime: DataFrame, keepers: DataFrame) -> DataFrame:
    """Add playing-time and keeper columns, one to one on the source ids; absent rows stay NULL, not zero."""
    key = ["league", "season", "player_id", "team_id"]
    return (cleaned.join(playingtime.select(*key, *PLAYINGTIME_SUMS, *WEIGHTED), key, "left")
            .join(keepers.select(*key, *KEEPER_SUMS), key, "left"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: must be empty before a one-to-one join."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def by_season(rows: DataFrame) -> DataFrame:
    """One row per player, league and season: counts added over teams, descriptions from the team with most minutes.

    Teams of one player in one season are few, so their ordered list is a bounded group.
    """
    extras = [c for c in PLAYINGTIME_SUMS + KEEPER_SUMS if c in rows.columns]
    first = F.max_by(F.struct("player", "provisional_id", "birth_year", "country", "position", "main_position", "age",
                              "season_start", "league_games", "partial_season", "team", "team_id"),
                     F.struct("minutes", -F.col("ranker"))).alias("_main")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("minutes")).alias("m"), F.col("ranker").alias("r"), "team")))
    out = rows.groupBy(*SEASON_KEY).agg(
        first, F.array_join(ordered["team"], " / ").alias("teams"), F.count_distinct("team").alias("n_teams"),
        *[F.sum(c).alias(c) for c in COUNTS], *[F.sum(c).alias(c) for c in extras],
        *[weighted_mean(c, w).alias(c) for c, w in WEIGHTED.items() if c in rows.columns])
    out = out.select(*SEASON_KEY, "_main.*", *[c for c in out.columns if c not in (*SEASON_KEY, "_main")])
    out = derived(out.withColumnRenamed("team", "main_team").withColumnRenamed("team_id", "main_team_id"))
    out = out.withColumn("minutes_share", F.least(F.lit(1.0), ratio("minutes", F.col("league_games") * 90)))
    if extras:
        out = out.withColumns({
            "plus_minus": F.col("on_goals_for") - F.col("on_goals_against"),
            "on_goals_against_per90": per90("on_goals_against", "minutes"),
            "gk_save_pct": ratio(100 * F.col("gk_saves"), "gk_shots_on_target_against"),
            "gk_clean_sheets_pct": ratio(100 * F.col("gk_clean_sheets"), "gk_games")})
    return out


def identity_candidates(df: DataFrame, aliases: dict[str, str] | None = None,
                        namesakes: list[str] | None = None) -> DataFrame:
    """Name keys that fall on several ids, one row per key and id, with the state of their review."""
    d = df.withColumn("name_key", text.name_key("player", "birth_year", "nationality"))
    per = d.groupBy("name_key", "player_id").agg(
        F.min_by("player", "ranker").alias("player"), F.min("season").alias("since"), F.max("season").alias("until"),
        F.min_by("position", "ranker").alias("position"), F.count_distinct("team").alias("teams"))
    several = per.groupBy("name_key").agg(F.count("player_id").alias("ids")).filter("ids > 1")
    known = list(aliases or {}) + list((aliases or {}).values())
    state = (F.when(F.col("player_id").isin(known), "alias").when(F.col("name_key").isin(list(namesakes or [])),
                                                                 "namesakes").otherwise("pending"))
    return per.join(several, "name_key").withColumn("state", state)


def impossible_totals(cleaned: DataFrame, summer_leagues: list[str]) -> DataFrame:
    """Players with more games than a season holds: within a league, or across leagues that share a calendar."""
    inside = cleaned.groupBy("player_key", "league", "season").agg(
        F.sum("games").alias("games"), F.max("league_games").alias("possible")).filter("games > possible + 1")
    across = cleaned.filter(~F.col("league").isin(summer_leagues)).groupBy("player_key", "season").agg(
        F.count_distinct("league").alias("n"), F.sum("games").alias("games"), F.max("league_games").alias("possible"))
    across = across.filter("n > 1 AND games > possible + 1")
    return inside.select("player_key", "season", F.lit("same league").alias("rule"), "games", "possible").unionByName(
        across.select("player_key", "season", F.lit("across leagues").alias("rule"), "games", "possible"))


def audit(raw: DataFrame, aliases: dict[str, str] | None = None, namesakes: list[str] | None = None,
          summer_leagues: list[str] | None = None) -> DataFrame:
    """One row per check: kind, number of cases and an example.

    Row checks share one pass; each grouped check reduces to its own small count.
    """
    df = typed(raw)
    content = [c for c in df.columns if c not in NOT_CONTENT]
    row_checks: dict[str, tuple[str, Column]] = {
        "empty minutes": ("error", F.col("minutes").isNull()),
        "other empty count": ("error", F.col("minutes").isNotNull() & _any_null([c for c in COUNTS if c != "minutes"])),
        "goals and assists do not add up": (
            "error", ~F.coalesce(F.col("goals_assists") == F.col("goals") + F.col("assists"), F.lit(False))),
        "goals without penalties do not add up": (
            "error", ~F.coalesce(F.col("goals_pens") == F.col("goals") - F.col("pens_made"), F.lit(False))),
        "more penalties scored than taken": ("error", F.coalesce(F.col("pens_made") > F.col("pens_att"), F.lit(False))),
        "row without id": ("error", F.col("player_id").isNull()),
        "player without own page": ("context", ~text.is_hex_id("player_id")),
        "empty birth year": ("context", F.col("birth_year").isNull()),
    }
    example = F.concat_ws(", ", "player", "team", "league", "season")
    wide = df.agg(*[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(row_checks.values())],
                  *[F.min_by(example, F.when(c, F.col("ranker"))).alias(f"e{i}")
                    for i, (_, c) in enumerate(row_checks.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(kind).alias("kind"), F.col(f"n{i}").alias("cases"),
                              F.when(F.col(f"n{i}") > 0, F.col(f"e{i}")).otherwise("").alias("example"))
                     for i, (name, (kind, _)) in enumerate(row_checks.items())])
    out = wide.select(F.explode(rows).alias("_r")).select("_r.*")

    keyed = player_key(df, aliases or {})
    normed = keyed.join(league_norms(df), ["league", "season"])

    def grouped(name, kind, frame, condition="true"):
        return frame.filter(condition).agg(F.count(F.lit(1)).alias("cases")).select(
            F.lit(name).alias("check"), F.lit(kind).alias("kind"), "cases", F.lit("").alias("example"))

    copies = df.groupBy(*content).agg((F.count(F.lit(1)) - 1).alias("n"))
    repeated = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cases")).select(
        F.lit("repeated row").alias("check"), F.lit("error").alias("kind"), "cases", F.lit("").alias("example"))
    births = df.groupBy("league", "season", "player").agg(F.count_distinct("birth_year").alias("n"))
    states = identity_candidates(df, aliases, namesakes).select("name_key", "state").distinct()
    # a key with an alias row counts as alias only
    states = states.groupBy("name_key").agg(F.min("state").alias("state"))
    moved = keyed.groupBy("player_key", "league", "season").agg(F.count_distinct("team").alias("n"))
    leagues = keyed.groupBy("player_key", "season").agg(F.count_distinct("league").alias("n"))
    cut = df.groupBy("league", "season").agg(F.max("games").alias("g"), F.count_distinct("team").alias("t"))
    parts = [
        repeated, grouped("same name, several birth years in a league season", "structure", births, "n > 1"),
        grouped("same name key, different people", "structure", states, "state = 'namesakes'"),
        grouped("one person, two ids", "error", states, "state = 'alias'"),
        grouped("identity candidates not reviewed", "structure", states, "state = 'pending'"),
        grouped("more games than a season holds", "error", impossible_totals(normed, summer_leagues or [])),
        grouped("several teams in one league season", "structure", moved, "n > 1"),
        grouped("several leagues in one season", "context", leagues, "n > 1"),
        grouped("shortened league season", "context", cut, "g < 2 * (t - 1)"),
    ]
    for p in parts:
        out = out.unionByName(p)
    return out


def _any_null(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def coverage(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Percentage of non-empty cells per key and column, long form."""
    wide = df.groupBy(*keys).agg(*[(100.0 * F.avg(F.col(c).isNotNull().cast("int"))).alias(c) for c in columns])
    return wide.unpivot(keys, columns, "column", "filled")


def available_since(cover: DataFrame, season: str, keys: list[str], threshold: float = 90.0) -> DataFrame:
    """First season from which a column is filled well enough."""
    return cover.groupBy(*keys, "column").agg(
        F.min(F.when(F.col("filled") >= threshold, F.col(season))).alias("available_since"))


def source_disagreement(seasons: DataFrame) -> DataFrame:
    """Per season: keepers whose conceded goals differ between the two sources."""
    both = seasons.filter(F.col("gk_games").isNotNull() & F.col("on_goals_against").isNotNull())
    return both.groupBy("season_start").agg(
        F.sum((F.col("gk_goals_against") != F.col("on_goals_against")).cast("int")).alias("disagree"),
        F.count(F.lit(1)).alias("keepers"))


def consolidation_evidence(df: DataFrame, ident: str, label: str, season: str) -> DataFrame:
    """Spellings of one identity key whose season ranges do not overlap: likely one person under two labels.

    Ranges are ordered by start and compared with the largest end so far, so no pairs are listed.
    """
    spans = df.groupBy(ident, label).agg(F.min(season).alias("since"), F.max(season).alias("until"))
    w = Window.partitionBy(ident).orderBy("since", "until", label).rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("_clash", F.coalesce(F.col("since") <= F.max("until").over(w), F.lit(False)))
    return marked.groupBy(ident).agg(
        F.count(F.lit(1)).alias("labels"), F.sum(F.col("_clash").cast("int")).alias("overlaps"),
        F.min("since").alias("since"), F.max("until").alias("until")).filter("labels > 1")
