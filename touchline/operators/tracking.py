"""Predictions frozen before kick-off: selection, overlay, live summary and lateness alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import ratio
from touchline.operators.evaluate import EVEN_RANGE
from touchline.operators.reshape import unseen

HORIZON_DAYS = 5
KEY = ["match_date", "home", "away"]


def kickoff_utc(date, time, zone: str) -> Column:
    """Local date and 'HH:MM' in a zone as an instant; NULL without a time."""
    d, t = (F.col(c) if isinstance(c, str) else c for c in (date, time))
    known = t.isNotNull() & (F.trim(t) != "")
    local = F.try_to_timestamp(F.concat_ws(" ", d.cast("string"), F.trim(t)), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(known, F.to_utc_timestamp(local, zone))


def has_started(date, time, now: Column, zone: str) -> Column:
    """Kick-off is past; with no time known only a past local date counts as started."""
    d = F.col(date) if isinstance(date, str) else date
    at = kickoff_utc(d, time, zone)
    return F.when(at.isNotNull(), at <= now).otherwise(d < F.from_utc_timestamp(now, zone).cast("date"))


def within_horizon(date, now: Column, days: int = HORIZON_DAYS, zone: str = "America/Mexico_City") -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return d <= F.date_add(F.from_utc_timestamp(now, zone).cast("date"), days)


def to_freeze(future: DataFrame, register: DataFrame, now: Column, zone: str,
              days: int = HORIZON_DAYS) -> DataFrame:
    """Predictions that can and should be frozen now: with a profile, unseen, not started, within the horizon."""
    open_ = future.filter(~F.col("no_profile") & ~has_started("match_date", "kickoff", now, zone)
                          & within_horizon("match_date", now, days))
    return unseen(open_, register, KEY)


def freeze_record(rows: DataFrame, now: Column, live_from: Column, model: str) -> DataFrame:
    """Columns of a register row: probabilities, flags and a note for rows before the official start."""
    three = [F.col(f"p_{k}") for k in ("home", "draw", "away")]
    early = F.col("match_date") < live_from
    return rows.withColumns({
        "frozen_at": F.date_format(now, "yyyy-MM-dd HH:mm"), "model": F.lit(model),
        "even": (F.greatest(*three) - F.least(*three)) <= EVEN_RANGE, "counts_live": ~early,
        "note": F.when(early, "before the official start").otherwise("")})


def unattended(fixtures: DataFrame, register: DataFrame, no_profile: DataFrame, now: Column, zone: str,
               days: int = HORIZON_DAYS) -> DataFrame:
    """Fixtures inside the horizon that nobody froze or set aside."""
    f = fixtures.filter(~has_started("match_date", "kickoff", now, zone) & within_horizon("match_date", now, days))
    return unseen(unseen(f, register, KEY), no_profile, KEY)


def leagues_needing_work(fixtures: DataFrame) -> DataFrame:
    return fixtures.groupBy("league").agg(F.count(F.lit(1)).alias("fixtures"),
                                          F.min("match_date").cast("string").alias("first_date"))


def overlay(predictions: DataFrame, register: DataFrame, fields: list[str]) -> DataFrame:
    """Frozen values over recomputed ones where present; marks frozen rows and regrades played ones."""
    r = register.select(*KEY, *[F.col(c).alias(f"_f_{c}") for c in fields],
                        F.col("counts_live").alias("_live"), F.lit(True).alias("_frozen"))
    out = predictions.join(r, KEY, "left")
    held = F.coalesce("_frozen", F.lit(False))
    out = out.withColumns({c: F.coalesce(f"_f_{c}", c) for c in fields}).withColumns(
        {"frozen": held, "live": F.coalesce("_live", F.lit(False))})
    out = out.withColumn("hit", F.when(F.col("actual").isNotNull(), F.col("pick") == F.col("actual")))
    return out.drop("_live", "_frozen", *[f"_f_{c}" for c in fields])


def live_summary(tracked: DataFrame, groups: list[str]) -> DataFrame:
    """Played, hits, home baseline, even matches and draws in them, among live rows."""
    three = [F.col(f"p_{k}") for k in ("home", "draw", "away")]
    even = (F.greatest(*three) - F.least(*three)) <= EVEN_RANGE
    played = tracked.filter("live AND actual IS NOT NULL").withColumn("_even", even)
    return played.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("played"), F.count_if("hit").alias("hits"),
        ratio(F.count_if(F.col("actual") == "H"), F.count(F.lit(1))).alias("home_baseline"),
        F.count_if("_even").alias("even_matches"),
        F.count_if(F.col("_even") & (F.col("actual") == "D")).alias("draws_in_even"),
        F.min("match_date").cast("string").alias("first_date"))


def unresolved(register: DataFrame, results: DataFrame, today: Column, margin_days: int = 2) -> DataFrame:
    """Frozen matches past the margin and later than the last result of their league: the source is behind."""
    last = results.groupBy("league").agg(F.max("match_date").alias("last_result"))
    late = register.join(last, "league").filter(
        (F.col("match_date") <= F.date_sub(today, margin_days)) & (F.col("match_date") > F.col("last_result")))
    return late.groupBy("league").agg(
        F.count(F.lit(1)).alias("waiting"), F.min("match_date").cast("string").alias("from"),
        F.max("match_date").cast("string").alias("to"), F.max("last_result").cast("string").alias("last_result"))


def freshness(results: DataFrame, today: Column) -> DataFrame:
    return results.groupBy("league").agg(F.datediff(today, F.max("match_date")).alias("days_since_result"))


def current_matchday(matches: DataFrame, today: Column) -> DataFrame:
    """Per league the nearest matchday that is not half played yet."""
    per = matches.groupBy("league", "season", "matchday").agg(
        F.avg(F.col("played").cast("double")).alias("done"), F.min("match_date").alias("begins"))
    open_ = per.filter("done < 0.5").withColumn("_gap", F.abs(F.datediff("begins", today)))
    return open_.groupBy("league").agg(
        F.min_by(F.struct("season", "matchday", F.col("begins").cast("string").alias("begins")),
                 F.struct("_gap", "season", "matchday")).alias("_m")).select("league", "_m.*")
