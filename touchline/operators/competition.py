"""Standings, format checks, snapshots and the competition calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numeric import ratio
from touchline.operators.reshape import team_rows


def blank_unplayed(matches: DataFrame, home_goals: str = "hg", away_goals: str = "ag",
                   played: str = "played") -> DataFrame:
    """No score before a match is played, whatever filler the source sends."""
    return matches.withColumns({g: F.when(F.col(played), F.col(g)) for g in (home_goals, away_goals)})


def standings(matches: DataFrame, keys: list[str]) -> DataFrame:
    """League table per key from played matches: 3 points a win, 1 a draw; points, difference, goals decide."""
    rows = team_rows(matches.filter("played"), keys, {"gf": ("hg", "ag"), "ga": ("ag", "hg")})
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    table = rows.groupBy(*keys, "team").agg(
        F.count(F.lit(1)).alias("played"), F.sum(points).alias("points"), F.sum("gf").alias("goals_for"),
        F.sum("ga").alias("goals_against"))
    table = table.withColumn("difference", F.col("goals_for") - F.col("goals_against"))
    place = Window.partitionBy(*keys).orderBy(F.desc("points"), F.desc("difference"), F.desc("goals_for"), "team")
    return table.withColumn("place", F.row_number().over(place).cast("bigint"))


def format_check(matches: DataFrame, keys: list[str], teams: int, per_team: int) -> DataFrame:
    """Departures from the published format per competition edition, each as a count, and whether all are zero."""
    side = team_rows(matches, keys, {})
    per = side.groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum((F.col("side") == "H").cast("int")).alias("home_n"))
    half, margin = per_team // 2, per_team % 2
    by_team = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("teams"),
        F.sum((F.col("n") != per_team).cast("int")).alias("teams_off_count"),
        F.sum((F.abs(F.col("home_n") - half) > margin).cast("int")).alias("teams_off_balance"))
    pairs = matches.groupBy(*keys, F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    repeated = pairs.groupBy(*keys).agg(F.sum((F.col("n") > 1).cast("int")).alias("repeated_pairings"))
    ids = matches.groupBy(*keys, "match_id").agg(F.count(F.lit(1)).alias("n"))
    twice = ids.groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("repeated_ids"))
    missing = F.col("hg").isNull() | F.col("ag").isNull()
    scored = F.col("hg").isNotNull() | F.col("ag").isNotNull()
    rows = matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"),
        F.sum((F.col("home") == F.col("away")).cast("int")).alias("against_itself"),
        F.sum((F.col("played") & missing).cast("int")).alias("played_without_score"),
        F.sum((~F.col("played") & scored).cast("int")).alias("unplayed_with_score"))
    out = rows.join(by_team, keys).join(repeated, keys).join(twice, keys)
    bad = ["teams_off_count", "teams_off_balance", "repeated_pairings", "repeated_ids", "against_itself",
           "played_without_score", "unplayed_with_score"]
    ok = (F.col("matches") == teams * per_team // 2) & (F.col("teams") == teams)
    for b in bad:
        ok = ok & (F.col(b) == 0)
    failures = F.array_compact(F.array(*[F.when(F.col(b) > 0, F.lit(b)) for b in bad]))
    return out.withColumn("failed_rules", F.concat_ws(",", failures)).withColumn("format_ok", ok)


def season_balance(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Teams that do not add up to 2(N-1) matches, and fixtures listed twice at the same venue, per season."""
    per = team_rows(matches, keys, {}).groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("n"))
    size = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("teams"))
    off = per.join(size, keys).groupBy(*keys).agg(
        F.max("teams").alias("teams"),
        F.sum((F.col("n") != 2 * (F.col("teams") - 1)).cast("int")).alias("teams_off"))
    venue = matches.groupBy(*keys, "home", "away").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.sum((F.col("n") > 1).cast("int")).alias("repeated_fixtures"))
    return off.join(venue, keys)


def neutrality_violations(matches: DataFrame, official="referee_country", home="home_country",
                          away="away_country") -> DataFrame:
    """Matches whose official comes from either side's country."""
    o = F.col(official)
    return matches.filter(o.isNotNull() & ((o == F.col(home)) | (o == F.col(away))))


def newly_played(snapshot: DataFrame, earlier: DataFrame) -> DataFrame:
    """Matches played now that an earlier snapshot did not have as played."""
    return snapshot.filter("played").join(earlier.filter("played").select("match_id"), "match_id", "left_anti")


def overview(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Results, upcoming and undated counts with the last and next dates per competition."""
    played = F.col("played")
    return matches.groupBy(*keys).agg(
        F.sum(played.cast("int")).alias("results"),
        F.sum((~played & F.col("match_date").isNotNull()).cast("int")).alias("upcoming"),
        F.sum(F.col("match_date").isNull().cast("int")).alias("undated"),
        F.max(F.when(played, F.col("match_date"))).cast("string").alias("last_result"),
        F.min(F.when(~played, F.col("match_date"))).cast("string").alias("first_upcoming"))


# --- calendar -------------------------------------------------------------------------------------------------------

def calendar_columns(df: DataFrame) -> DataFrame:
    """Length in days and whether the dates are still provisional."""
    return df.withColumn("days", F.datediff("end", "start") + 1).withColumn(
        "provisional", F.coalesce(F.col("confirmed") != "si", F.lit(True)))


def _months(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))


def overlapping_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Interval join by month: every pair of rows (prefixed a_, b_) whose date ranges meet, each pair once.

    Both sides are listed under the months they touch and joined on the month; a pair counts only in the month
    where its overlap begins.
    """
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).withColumn(
        "month", _months(F.col("a_start"), F.col("a_end")))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn(
        "month", _months(F.col("b_start"), F.col("b_end")))
    begin, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return left.join(right, "month").filter((begin <= end) & (F.col("month") == F.trunc(begin, "month"))).withColumns(
        {"from": begin, "to": end, "overlap_days": F.datediff(end, begin) + 1}).drop("month")


def overlaps(calendar: DataFrame, tournaments_only: bool = True) -> DataFrame:
    """Pairs of different competitions that share dates."""
    t = calendar.filter("kind = 'torneo'") if tournaments_only else calendar
    pairs = overlapping_pairs(t, t).filter(
        (F.col("a_row_id") < F.col("b_row_id")) & (F.col("a_competition") != F.col("b_competition")))
    return pairs.select(
        F.concat_ws(" ", "a_competition", "a_edition").alias("competition_a"),
        F.concat_ws(" ", "b_competition", "b_edition").alias("competition_b"),
        "from", "to", "overlap_days",
        (F.col("a_provisional") | F.col("b_provisional")).alias("any_provisional"))


def window_contents(calendar: DataFrame) -> DataFrame:
    """Each international window with the tournaments that fall in it, '—' when none does."""
    windows = calendar.filter("kind = 'ventana'")
    pairs = overlapping_pairs(windows, calendar.filter("kind = 'torneo'"))
    label = F.concat(F.col("b_competition"), F.lit(" ("), F.col("b_phase"), F.lit(")"))
    # a window spans days, so the competitions inside one are bounded by the calendar
    named = pairs.withColumn("_l", label).groupBy("a_row_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("b_start", "b_row_id", "_l")))["_l"], " + ").alias("occupied_by"))
    return windows.join(named, windows["row_id"] == named["a_row_id"], "left").select(
        "edition", "start", "end", "days", "phase", F.coalesce("occupied_by", F.lit("—")).alias("occupied_by"))


def countdown(calendar: DataFrame, today: Column, before: Column, scope: str | None = None) -> DataFrame:
    """Tournaments still to end that start before a date, with days to go and whether they are under way."""
    t = calendar.filter((F.col("kind") == "torneo") & (F.col("end") >= today) & (F.col("start") < before))
    if scope:
        t = t.filter(F.col("scope") == scope)
    return t.withColumns({"days_to_start": F.greatest(F.datediff("start", today), F.lit(0)),
                          "under_way": (F.col("start") <= today) & (F.col("end") >= today)})


def active_windows(calendar: DataFrame, today: Column, margin_days: int = 3) -> DataFrame:
    """Windows open today, from one day before to some days after their end."""
    return calendar.filter((F.col("kind") == "ventana") & (F.date_sub("start", 1) <= today)
                           & (today <= F.date_add("end", margin_days)))


# --- names ----------------------------------------------------------------------------------------------------------

def match_names(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """Map each left name to the right name sharing most words, inside a block such as a league.

    Words meet on their first three letters, so only names with a word in common are compared. A tie for best, no
    match at all, or two left names claiming one right name leave the name unresolved: nothing is guessed.
    """
    from touchline.functions.text import name_tokens, shared_tokens

    a = left.select(block, F.col("name").alias("left_name"), name_tokens("name").alias("_lt")).distinct()
    b = right.select(block, F.col("name").alias("right_name"), name_tokens("name").alias("_rt")).distinct()
    ak = a.withColumn("_w", F.explode(F.array_distinct(F.transform("_lt", lambda w: F.substring(w, 1, 3)))))
    bk = b.withColumn("_w", F.explode(F.array_distinct(F.transform("_rt", lambda w: F.substring(w, 1, 3)))))
    pairs = ak.join(bk, [block, "_w"]).select(block, "left_name", "right_name",
                                              shared_tokens("_lt", "_rt").alias("score")).distinct()
    best = pairs.groupBy(block, "left_name").agg(F.max("score").alias("best"))
    top = pairs.join(best, [block, "left_name"]).filter((F.col("score") == F.col("best")) & (F.col("best") > 0))
    single = top.groupBy(block, "left_name").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("right_name").alias("right_name"), F.max("best").alias("score"))
    claims = single.filter("candidates = 1").groupBy(block, "right_name").agg(F.count(F.lit(1)).alias("claims"))
    out = a.select(block, "left_name").join(single, [block, "left_name"], "left").join(
        claims, [block, "right_name"], "left")
    state = (F.when(F.col("candidates").isNull(), "no match").when(F.col("candidates") > 1, "ambiguous")
             .when(F.col("claims") > 1, "collision").otherwise("matched"))
    return out.select(block, "left_name", state.alias("state"),
                      F.when(state == "matched", F.col("right_name")).alias("right_name"), "score")


def remaining_fixtures(feed: DataFrame, names: DataFrame, played: DataFrame, keys: list[str]) -> DataFrame:
    """Calendar feed in our names without fixtures already played (by pairing, not by date), undated ones dropped."""
    h = names.select(*keys, F.col("left_name").alias("home_raw"), F.col("right_name").alias("home"))
    a = names.select(*keys, F.col("left_name").alias("away_raw"), F.col("right_name").alias("away"))
    mapped = feed.join(h, [*keys, "home_raw"]).join(a, [*keys, "away_raw"])
    return mapped.join(played.select(*keys, "home", "away"), [*keys, "home", "away"], "left_anti").filter(
        F.col("match_date").isNotNull())


def points_per_match(table: DataFrame) -> DataFrame:
    return table.withColumn("ppm", ratio("points", "played"))
