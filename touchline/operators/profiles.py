"""Pre-match team profiles that never see the match they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numeric import ratio
from touchline.operators.ordered import (ROLLING_CHUNK, _with_halo, expanding_before, number_rows, rolling_before,
                                         totals_before_day)
from touchline.operators.reshape import team_rows

# profile name -> (home column, away column) seen from the home side
METRICS = {
    "goals_for": ("hg", "ag"), "goals_against": ("ag", "hg"), "corners": ("hc", "ac"),
    "cards": ("h_cards", "a_cards"), "on_target_for": ("hst", "ast"), "on_target_against": ("ast", "hst"),
}


def with_cards(matches: DataFrame) -> DataFrame:
    return matches.withColumns({"h_cards": F.col("hy") + F.col("hr"), "a_cards": F.col("ay") + F.col("ar")})


def match_profiles(matches: DataFrame, window: int | None, min_prev: int, max_gap_days: int | None = None,
                   metrics: dict | None = None) -> DataFrame:
    """Home-as-home and away-as-away averages before each match, one row per match.

    `window` None averages all earlier matches, else the last `window`. A pause above `max_gap_days` discards what
    came before it.
    """
    metrics = metrics or METRICS
    long = team_rows(with_cards(matches), ["match_id", "match_date", "league"], metrics).drop("rival")
    keys = ["league", "team", "side"]
    seq = number_rows(long, keys, "match_date", "match_id", "seq", max_gap_days)
    keys = keys if max_gap_days is None else [*keys, "segment"]
    if window is None:
        prev = expanding_before(seq, keys, "seq", list(metrics), min_prev)
    else:
        prev = rolling_before(seq, keys, "seq", list(metrics), window, min_prev)
    back = prev.groupBy("match_id").agg(*[
        F.max(F.when(F.col("side") == s, F.col(f"{m}_prev"))).alias(f"{label}_{m}")
        for s, label in (("H", "home"), ("A", "away")) for m in metrics])
    return matches.join(back, "match_id")


def profile_grid(matches: DataFrame, windows: list[int], min_prev: int, metrics: dict | None = None) -> DataFrame:
    """Profiles for many window lengths from one pass over the team rows: one row per match and window, 0 for all earlier matches.

    Every chunk of a team's rows carries one array of running sums and counts; a window's sum is the array minus the same
    array so many rows before. What lies before the chunk is added from totals per chunk.
    """
    metrics = metrics or METRICS
    names, lengths = list(metrics), sorted(n for n in windows if n)
    keys = ["league", "team", "side"]
    long = team_rows(with_cards(matches), ["match_id", "match_date", "league"], metrics).drop("rival")
    seq = number_rows(long, keys, "match_date", "match_id", "seq")
    reach = max([*lengths, 1])
    rows = _with_halo(seq, "seq", reach, max(ROLLING_CHUNK, reach))
    own = F.col("_home") == F.col("_chunk")
    totals = rows.filter(own).groupBy(*keys, "_chunk").agg(F.array(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in names], *[F.count(c).cast("double") for c in names]).alias("_t"))
    carried = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_chunk", F.array(*[F.coalesce(F.sum(F.col("_t")[k]).over(carried), F.lit(0.0)) for k in range(2 * len(names))]).alias("_t"))
    order = Window.partitionBy(*keys, "_chunk").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def running(kept) -> Column:
        values = [F.when(kept, F.col(c)) for c in names]
        return F.array(*[F.coalesce(F.sum(v).over(before), F.lit(0)).cast("double") for v in values],
                       *[F.count(v).over(before).cast("double") for v in values])

    rows = rows.withColumns({"_run": running(F.lit(True)), "_own": running(own)})
    rows = rows.withColumns({f"_run{n}": F.lag("_run", n).over(order) for n in lengths}).filter(own).join(totals, [*keys, "_chunk"])

    def means(window: int, total) -> Column:
        known = {c: total(len(names) + k) for k, c in enumerate(names)}
        return F.struct(F.lit(window).alias("window"), *[F.when(known[c] >= min_prev, total(k) / known[c]).alias(c) for k, c in enumerate(names)])

    asked = [means(n, lambda k, n=n: F.col("_run")[k] - F.coalesce(F.col(f"_run{n}")[k], F.lit(0.0))) for n in lengths]
    if 0 in windows:
        asked.append(means(0, lambda k: F.col("_own")[k] + F.col("_t")[k]))
    each = rows.select("match_id", "side", F.inline(F.array(*asked)))
    return each.groupBy("match_id", "window").agg(*[
        F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{label}_{m}") for s, label in (("H", "home"), ("A", "away")) for m in names])


def profiles_as_of(matches: DataFrame, min_league_matches: int, metrics: dict | None = None) -> DataFrame:
    """Averages over all strictly earlier dates, once the league has enough history; one pass, no loop over dates."""
    metrics = metrics or METRICS
    cards = with_cards(matches)
    long = team_rows(cards, ["match_id", "match_date", "league"], metrics).drop("rival")
    before = totals_before_day(long, ["league", "team", "side"], "match_date", {
        "_n": F.count(F.lit(1)), **{m: F.sum(m) for m in metrics}})
    past = totals_before_day(matches, ["league"], "match_date", {"history": F.count(F.lit(1))})
    out = matches.join(past, ["league", "match_date"]).filter(F.col("history") >= min_league_matches)
    for s, label in (("H", "home"), ("A", "away")):
        side = before.filter(F.col("side") == s).select(
            "league", F.col("team").alias(label), "match_date",
            F.col("_n").alias(f"{label}_matches"),
            *[ratio(m, "_n").alias(f"{label}_{m}") for m in metrics])
        out = out.join(side, ["league", label, "match_date"])
    return out.filter((F.col("home_matches") > 0) & (F.col("away_matches") > 0))


def referee_strictness_as_of(matches: DataFrame, min_league_matches: int) -> DataFrame:
    """Mean cards of each referee over strictly earlier dates."""
    cards = with_cards(matches).withColumn("cards", F.col("h_cards") + F.col("a_cards"))
    before = totals_before_day(cards, ["league", "referee"], "match_date",
                               {"_n": F.count(F.lit(1)), "_s": F.sum("cards")})
    past = totals_before_day(matches, ["league"], "match_date", {"history": F.count(F.lit(1))})
    return (cards.join(past, ["league", "match_date"]).filter(F.col("history") >= min_league_matches)
            .join(before, ["league", "referee", "match_date"])
            .withColumn("strictness", ratio("_s", "_n")).withColumnRenamed("_n", "earlier_matches")
            .drop("_s", "history"))


def profiles_prior_seasons(matches: DataFrame, metrics: dict | None = None) -> DataFrame:
    """Averages over seasons strictly before the match's own, from season totals."""
    metrics = metrics or METRICS
    long = team_rows(with_cards(matches), ["season", "league"], metrics).drop("rival")
    keys = ["league", "team", "side"]
    totals = long.groupBy(*keys, "season").agg(F.count(F.lit(1)).alias("_n"),
                                              *[F.sum(m).alias(m) for m in metrics])
    w = Window.partitionBy(*keys).orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    lagged = totals.select(*keys, "season", F.sum("_n").over(w).alias("_n"),
                           *[F.sum(m).over(w).alias(m) for m in metrics])
    out = matches
    for s, label in (("H", "home"), ("A", "away")):
        side = lagged.filter(F.col("side") == s).select(
            "league", F.col("team").alias(label), "season", F.col("_n").alias(f"{label}_matches"),
            *[ratio(m, "_n").alias(f"{label}_{m}") for m in metrics])
        out = out.join(side, ["league", label, "season"], "left")
    return out


def matchday_numbers(matches: DataFrame) -> DataFrame:
    """n-th match of each team in its season; a match takes the larger of its two teams' numbers."""
    long = team_rows(matches, ["match_id", "match_date", "league", "season"], {}).drop("rival", "side")
    seq = number_rows(long, ["league", "season", "team"], "match_date", "match_id", "nth")
    day = seq.groupBy("match_id").agg(F.max("nth").alias("matchday"))
    return matches.join(day, "match_id")


def head_to_head(matches: DataFrame, margin: float = 0.15) -> DataFrame:
    """Record of both teams' earlier meetings (either venue) before each match, from the home side's view."""
    first, second = F.least("home", "away"), F.greatest("home", "away")
    diff = F.when(F.col("home") == first, F.col("hg") - F.col("ag")).otherwise(F.col("ag") - F.col("hg"))
    pairs = matches.withColumns({"first": first, "second": second}).withColumn("_d", diff)
    before = totals_before_day(pairs, ["league", "first", "second"], "match_date", {
        "meetings": F.count("_d"), "_sum": F.sum("_d"),
        "_won": F.sum((F.col("_d") > 0).cast("int")), "_lost": F.sum((F.col("_d") < 0).cast("int"))})
    out = pairs.drop("_d").join(before, ["league", "first", "second", "match_date"])
    sign = F.when(F.col("home") == F.col("first"), 1).otherwise(-1)
    mean = ratio(F.col("_sum") * sign, "meetings")
    n = F.coalesce(F.col("meetings"), F.lit(0))
    at_home = F.col("home") == F.col("first")
    return out.select(
        "match_id", "home", "away", n.alias("meetings"), mean.alias("mean_diff"),
        F.when(mean > margin, F.col("home")).when(mean < -margin, F.col("away"))
        .when(mean.isNotNull(), F.lit("even")).alias("favourite"),
        F.coalesce(F.when(at_home, F.col("_won")).otherwise(F.col("_lost")), F.lit(0)).alias("home_wins"),
        (n - F.coalesce(F.col("_won") + F.col("_lost"), F.lit(0))).alias("draws"),
        F.coalesce(F.when(at_home, F.col("_lost")).otherwise(F.col("_won")), F.lit(0)).alias("away_wins"))


def window_study(matches: DataFrame, windows: list[int]) -> DataFrame:
    """How well the mean of the last 1..k seasons (0 = all) predicts a team's goals per match in the next season.

    Window sizes are rows: each season total is sent to the seasons it helps to predict.
    """
    long = team_rows(matches, ["season", "league"], {"goals": ("hg", "ag")}).drop("rival")
    totals = long.groupBy("league", "team", "side", "season").agg(
        F.count(F.lit(1)).alias("n"), F.sum("goals").alias("goals"))
    last = totals.agg(F.max("season")).scalar()
    sizes = F.array(*[F.lit(k) for k in windows])
    spread = (totals.withColumn("seasons", F.explode(sizes)).withColumn("_last", last)
              .withColumn("_to", F.when(F.col("seasons") == 0, F.col("_last"))
                          .otherwise(F.least(F.col("season") + F.col("seasons"), F.col("_last"))))
              .filter(F.col("season") < F.col("_to"))
              .withColumn("season", F.explode(F.sequence(F.col("season") + 1, F.col("_to")))))
    keys = ["league", "team", "side", "season"]
    past = spread.groupBy(*keys, "seasons").agg(ratio(F.sum("goals"), F.sum("n")).alias("predicted"))
    now = totals.select(*keys, ratio("goals", "n").alias("actual"), "n")
    return now.join(past, keys)
