"""Nested match feeds to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.competition import blank_unplayed

TEAM = "struct<internationalName:string,countryCode:string,translations:struct<displayName:map<string,string>>>"
FEED_A = (
    "id string, status string, kickOffTime struct<dateTime:string>, matchAttendance bigint, "
    "group struct<metaData:struct<groupName:string>,league:struct<metaData:struct<leagueName:string>,translations:struct<name:map<string,string>>>>, "
    "round struct<metaData:struct<name:string>,translations:struct<name:map<string,string>>>, matchday struct<longName:string>, "
    f"homeTeam {TEAM}, awayTeam {TEAM}, score struct<total:struct<home:int,away:int>>, "
    "stadium struct<translations:struct<officialName:map<string,string>>>, "
    "referees array<struct<role:string,person:struct<countryCode:string,internationalName:string,translations:struct<name:map<string,string>>>>>")
FEED_B = (
    "matchId string, status string, dateVenue string, timeVenueUTC string, stage struct<name:string>, group struct<name:string>, "
    "homeTeam struct<name:string,countryCode:string>, awayTeam struct<name:string,countryCode:string>, "
    "result struct<homeGoals:int,awayGoals:int>, stadium struct<name:string>, "
    "referees array<struct<role:string,refereeName:string,countryCode:string>>")


def translated(texts: Column, language: str = "ES") -> Column:
    """A text in the wanted language, else English, else any that is not empty."""
    full = F.filter(F.map_values(texts), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(F.nullif(F.try_element_at(texts, F.lit(language)), F.lit("")),
                      F.nullif(F.try_element_at(texts, F.lit("EN")), F.lit("")), F.try_element_at(full, F.lit(1)))


def principal(referees: Column, role: str) -> Column:
    """The official whose role is exactly the given one; assistants do not count."""
    return F.try_element_at(F.filter(referees, lambda r: F.lower(F.trim(r["role"])) == role.lower()), F.lit(1))


def parse(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text to the feed's columns."""
    return df.select(F.from_json(column, F.lit(schema)).alias("_m")).select("_m.*")


def feed_a(raw: DataFrame) -> DataFrame:
    """First provider (nations and club competitions): names translated, principal official and country."""
    r = raw.withColumn("_ref", principal(F.col("referees"), "REFEREE"))
    c = F.col
    played = c("status") == "FINISHED"
    out = r.select(
        c("id").alias("match_id"), F.substring("kickOffTime.dateTime", 1, 10).alias("date"), F.substring("kickOffTime.dateTime", 12, 5).alias("time"),
        F.coalesce(translated(c("group.league.translations.name")), c("group.league.metaData.leagueName"), F.lit("")).alias("league"),
        F.coalesce(c("group.metaData.groupName"), F.lit("")).alias("group"),
        F.coalesce(translated(c("round.translations.name")), c("round.metaData.name"), F.lit("")).alias("phase"),
        F.coalesce(c("matchday.longName"), F.lit("")).alias("matchday"),
        F.coalesce(translated(c("homeTeam.translations.displayName")), c("homeTeam.internationalName")).alias("home"),
        F.coalesce(translated(c("awayTeam.translations.displayName")), c("awayTeam.internationalName")).alias("away"),
        c("homeTeam.countryCode").alias("home_country"), c("awayTeam.countryCode").alias("away_country"),
        c("score.total.home").alias("hg"), c("score.total.away").alias("ag"), c("status"),
        F.coalesce(translated(c("_ref.person.translations.name")), c("_ref.person.internationalName")).alias("referee"),
        c("_ref.person.countryCode").alias("referee_country"),
        translated(c("stadium.translations.officialName")).alias("stadium"), c("matchAttendance").alias("attendance"),
        F.coalesce(played, F.lit(False)).alias("played"))
    return out


def feed_b(raw: DataFrame) -> DataFrame:
    """Second provider: other names, filler scores of unplayed matches removed."""
    r = raw.withColumn("_ref", principal(F.col("referees"), "Referee"))
    c = F.col
    out = r.select(
        c("matchId").alias("match_id"), c("dateVenue").alias("date"), F.substring("timeVenueUTC", 1, 5).alias("time"),
        F.coalesce(c("stage.name"), F.lit("")).alias("phase"), F.coalesce(c("group.name"), F.lit("")).alias("group"),
        c("homeTeam.name").alias("home"), c("awayTeam.name").alias("away"), c("homeTeam.countryCode").alias("home_country"),
        c("awayTeam.countryCode").alias("away_country"), c("result.homeGoals").alias("hg"), c("result.awayGoals").alias("ag"),
        c("status"), c("stadium.name").alias("stadium"), c("_ref.refereeName").alias("referee"), c("_ref.countryCode").alias("referee_country"),
        (F.coalesce(c("status") == "played", F.lit(False)) & c("result.homeGoals").isNotNull()).alias("played"))
    return blank_unplayed(out)


def listed_officials(df: DataFrame, column: str, role: str = "REFEREE") -> DataFrame:
    """A text cell holding a list of records with single quotes: name and country of one role.

    The country field is accepted under its correct and its misspelt name.
    """
    schema = "array<struct<name:string,role:string,country_code:string,counrty_code:string>>"
    parsed = F.from_json(F.regexp_replace(column, "\\bNone\\b", "null"), F.lit(schema), {"allowSingleQuotes": "true"})
    one = F.try_element_at(F.filter(parsed, lambda r: r["role"] == role), F.lit(1))
    return df.withColumn("_o", one).withColumns({
        "referee": F.col("_o.name"), "referee_country": F.coalesce("_o.country_code", "_o.counrty_code")}).drop("_o")
