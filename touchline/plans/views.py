"""Domain views over the given tables.

Each view is a list of plain SQL expressions. Spark reads them through `selectExpr`; the checking SQL is the same list
as common table expressions, so both engines start from identical rows and only the operators differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# name -> (source, [expressions], filter)
_STEPS: dict[str, tuple[str, list[str], str | None]] = {}


def _define(name: str, source: str, exprs: list[str], where: str | None = None) -> None:
    _STEPS[name] = (source, exprs, where)


_define("m0", "orders", [
    "o_orderkey AS match_id",
    "cast(o_orderdate as date) AS match_date",
    "cast(year(o_orderdate) as bigint) AS season",
    "cast(month(o_orderdate) as bigint) AS month_no",
    "cast(floor(o_custkey / 50) as bigint) AS league_no",
    "cast(floor(o_custkey / 5) as bigint) % 10 AS hs",
    "(7 * o_orderkey + o_custkey) % 10 AS as0",
    "cast(floor(o_totalprice) as bigint) AS p1",
    "cast(floor(o_totalprice / 5) as bigint) AS p5",
    "o_orderstatus <> 'P' AS played",
    "o_custkey AS cust",
])

# One football match per order: ten teams per league, leagues grow with the data.
_define("v_match", "m0", [
    "match_id", "match_date", "season", "month_no", "league_no", "played", "cust",
    "concat('L', cast(league_no as string)) AS league",
    "concat('T', cast(league_no * 10 + hs as string)) AS home",
    "concat('T', cast(league_no * 10 + case when as0 = hs then (hs + 1) % 10 else as0 end as string)) AS away",
    "p1 % 5 AS hg", "p5 % 4 AS ag",
    "match_id % 11 AS hc", "cast(floor(match_id / 3) as bigint) % 9 AS ac",
    "match_id % 5 AS hy", "cast(floor(match_id / 5) as bigint) % 6 AS ay",
    "case when match_id % 23 = 0 then 1 else 0 end AS hr",
    "case when match_id % 19 = 0 then 1 else 0 end AS ar",
    "cast(floor(match_id / 7) as bigint) % 9 AS hst", "cast(floor(match_id / 11) as bigint) % 8 AS ast",
    "5 + match_id % 13 AS hf", "6 + cast(floor(match_id / 2) as bigint) % 12 AS af",
    "concat('R', cast(league_no * 4 + cast(floor(match_id / 13) as bigint) % 4 as string)) AS referee",
    "concat('C', cast(cast(floor(match_id / 17) as bigint) % 9 as string)) AS referee_country",
    "concat('C', cast(hs % 7 as string)) AS home_country",
    "concat('C', cast(as0 % 7 as string)) AS away_country",
    "case when match_id % 97 = 0 then null else 1.5 + (match_id % 37) / 10.0E0 end AS odds_h",
    "2.8 + (match_id % 23) / 10.0E0 AS odds_d",
    "1.6 + (match_id % 41) / 10.0E0 AS odds_a",
    "case when month_no >= 11 then 'playoff' else 'regular' end AS phase",
])

_define("p0", "lineitem", [
    "l_partkey AS pk",
    "cast(year(l_shipdate) as bigint) AS yr",
    "(l_partkey + cast(floor(year(l_shipdate) / 2) as bigint)) % 5 AS lg",
    "cast(floor(l_partkey / 60) as bigint) + cast(floor(year(l_shipdate) / 3) as bigint) % 2"
    " + case when l_linenumber >= 6 then 1 else 0 end AS tm",
    "l_linenumber AS ln", "l_quantity AS q", "l_returnflag AS rf", "l_linestatus AS ls",
    "l_discount AS disc", "l_tax AS tax",
])

# Player-team-season counts, before any defect is put in.
_PANEL_COUNTS = [
    "count(*) AS g", "sum(case when q >= 15 then 1 else 0 end) AS st",
    "cast(sum(q) as bigint) AS qs",
    "sum(case when rf = 'R' then 1 else 0 end) AS gl",
    "sum(case when rf = 'A' then 1 else 0 end) AS asi",
    "sum(case when ln = 1 and rf = 'R' then 1 else 0 end) AS pm",
    "sum(case when ln = 1 and rf <> 'N' then 1 else 0 end) AS pa",
    "sum(case when ls = 'F' and ln in (2, 5) then 1 else 0 end) AS yc",
    "sum(case when ls = 'F' and ln = 7 and q > 40 then 1 else 0 end) AS rc",
    "sum(case when disc < 0.035 then 1 else 0 end) AS w",
    "sum(case when disc >= 0.035 and disc < 0.065 then 1 else 0 end) AS d",
    "sum(case when tax < 0.025 then 1 else 0 end) AS cs",
    "sum(cast(ln as bigint)) AS lsum",
]
_PANEL_KEYS = ["pk", "yr", "lg", "tm"]

_define("p2", "p1", [
    "*",
    "concat('00000000', lower(hex(pk))) AS hx",
    "pk % 4 AS ps",
])

# The raw panel as a source would deliver it: text ids, text minutes with separators, missing cells, repeated rows.
_define("p3", "p2", [
    "cast(pk * 100000 + yr * 10 + tm % 10 as bigint) AS ranker",
    "concat('Jugadór ', cast(pk - pk % 2 * (case when pk % 50 = 1 then 1 else 0 end) as string)) AS player",
    "concat('xx N', cast((pk - pk % 2) % 6 as string)) AS nationality",
    "case ps when 0 then 'GK' when 1 then 'DF' when 2 then 'MF,FW' else 'FW' end AS position",
    "concat('Club ', cast(lg as string), '-', cast(tm as string)) AS team",
    "concat('LG', cast(lg as string)) AS league",
    "concat(cast(yr as string), '-', cast(yr + 1 as string)) AS season",
    "case when yr = 2001 then concat(cast(18 + (pk + yr) % 18 as string), '-100')"
    " else cast(18 + (pk + yr) % 18 as string) end AS age",
    "case when pk % 37 = 0 then null else cast(1970 + (pk - pk % 2) % 30 as double) end AS birth_year",
    "cast(g as double) AS games", "cast(st as double) AS games_starts",
    "case when pk % 31 = 0 and yr = 1998 then null"
    " when qs * 8 >= 1000 then concat(cast(cast(floor(qs * 8 / 1000) as bigint) as string), ',',"
    " lpad(cast(qs * 8 % 1000 as string), 3, '0'))"
    " else cast(qs * 8 as string) end AS minutes",
    "case when pk % 31 = 0 and yr = 1998 then 0.0E0 else round(qs * 8 / 90.0E0, 1) end AS minutes_90s",
    "cast(gl as double) AS goals",
    "case when pk % 29 = 0 and yr = 1997 then null else cast(asi as double) end AS assists",
    "cast(pm as double) AS pens_made",
    "case when pk % 41 = 0 then 0.0E0 else cast(pa as double) end AS pens_att",
    "cast(yc as double) AS cards_yellow", "cast(rc as double) AS cards_red",
    "case when pk % 29 = 0 then null else cast(gl + asi as double) end AS goals_assists",
    "case when pk % 43 = 0 then cast(gl as double) else cast(gl - pm as double) end AS goals_pens",
    "substr(hx, length(hx) - 7, 8) AS hid",
    "case when pk % 61 = 5 then concat('Jugador-', cast(pk as string)) else substr(hx, length(hx) - 7, 8) end AS player_id",
    "concat('t', cast(lg as string), 'x', cast(tm as string)) AS team_id",
    "case when pk % 101 = 7 then 2 else 1 end AS copies",
    "pk", "yr", "g", "qs", "w", "d", "cs", "lsum", "ps",
])

# Extra tables, one row per player-team-season.
_define("v_playingtime", "p3", [
    "league", "season", "player_id", "team_id",
    "cast(g - 1 as double) AS games_complete", "cast(lsum % 4 as double) AS games_subs",
    "cast(lsum % 7 as double) AS unused_subs",
    "case when yr <= 1995 then null else cast(qs % 23 as double) end AS on_goals_for",
    "case when yr <= 1995 then null else cast(lsum % 19 as double) end AS on_goals_against",
    "case when yr <= 1995 then null else (qs % 30) / 10.0E0 end AS points_per_game",
    "case when yr <= 1995 then null else (qs % 41 - 20) / 10.0E0 end AS plus_minus_wowy",
])
_define("v_keepers", "p3", [
    "league", "season", "player_id", "team_id",
    "cast(g as double) AS gk_games", "cast(g as double) AS gk_games_starts",
    "cast(90 * g + (pk % 7) * 30 as double) AS gk_minutes",
    "cast(lsum % 19 as double) AS gk_goals_against",
    "cast(lsum % 19 + qs % 60 as double) AS gk_shots_on_target_against",
    "case when yr = 1999 and pk % 3 = 0 then null else cast(qs % 60 as double) end AS gk_saves",
    "cast(w as double) AS gk_wins", "cast(d as double) AS gk_ties", "cast(g - w - d as double) AS gk_losses",
    "cast(cs as double) AS gk_clean_sheets",
    "cast(lsum % 5 as double) AS gk_pens_att", "cast(lsum % 3 as double) AS gk_pens_allowed",
    "case when yr <= 1996 then null else cast(lsum % 2 as double) end AS gk_pens_saved",
    "cast(lsum % 2 as double) AS gk_pens_missed",
], "ps = 0")

_define("e0", "events", [
    "event_id", "ts", "user_id", "event_type", "value",
    "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) AS k",
    "cast(floor((cast(unix_day AS bigint) - 19723) / 6) as bigint) AS block",
    "unix_minute AS minute_of_day",
])

# On-ball events (places in half yards, so that sums are exact): a match is a six-day block of one team pair, a team is fifteen users.
_define("v_events", "e0", [
    "event_id", "ts",
    "cast(floor(user_id / 30) as bigint) * 10 + block AS match_id",
    "concat('E', cast(cast(floor(user_id / 15) as bigint) as string)) AS team",
    "cast(floor(user_id / 15) as bigint) AS team_no",
    "user_id AS player_id", "concat('P', cast(user_id as string)) AS player",
    "user_id % 15 < 11 AS starter",
    "case event_type when 'view' then 'Pass' when 'click' then 'Carry' when 'purchase' then 'Shot'"
    " when 'error' then 'Duel' else 'Dribble' end AS type",
    "case when event_type = 'view' and k % 3 = 0 then 'Incomplete' else null end AS pass_outcome",
    "case when event_type = 'purchase' then case k % 4 when 0 then 'Goal' when 1 then 'Saved' else 'Off T' end"
    " else null end AS shot_outcome",
    "case when event_type = 'error' then case k % 3 when 0 then 'Won' when 1 then 'Success In Play' else 'Lost' end"
    " else null end AS duel_outcome",
    "case when k % 2 = 0 then 'Complete' else 'Incomplete' end AS dribble_outcome",
    "cast(cast(floor(value * 700) as bigint) % 240 as double) / 2.0E0 AS x",
    "cast((k * 80 + cast(floor(value * 100) as bigint)) % 160 as double) / 2.0E0 AS y",
    "minute_of_day % 95 AS minute",
    "case user_id % 15 when 0 then 'Goalkeeper' when 1 then 'Right Back' when 2 then 'Left Back'"
    " when 3 then 'Center Back' when 4 then case when block % 2 = 0 then 'Center Back' else 'Center Midfield' end"
    " when 5 then 'Center Midfield' when 6 then 'Right Midfield' when 7 then 'Left Midfield'"
    " when 8 then case when block % 2 = 0 then 'Right Wing' else 'Left Wing' end"
    " when 9 then 'Center Forward' else 'Secondary Striker' end AS position",
    "block",
])

# Bets on matches: one leg per order, some grouped into combined bets of one customer and season.
_define("v_bets", "v_match", [
    "match_id AS bet_id", "match_id", "league", "match_date", "season",
    "case match_id % 9 when 0 then '1x2' when 1 then 'doble_oportunidad' when 2 then 'over_under_goles'"
    " when 3 then 'tarjetas_over_under' when 4 then 'corners_over_under' when 5 then 'ambos_anotan'"
    " when 6 then 'handicap' when 7 then 'marcador_exacto' else 'otro' end AS kind",
    "case match_id % 9"
    " when 0 then case cust % 3 when 0 then 'Local' when 1 then 'Empate' else 'Visitante' end"
    " when 1 then case cust % 3 when 0 then '1X' when 1 then 'X2' else '12' end"
    " when 5 then case cust % 2 when 0 then 'si' else 'no' end"
    " when 6 then case cust % 2 when 0 then 'Local' else 'Visitante' end"
    " when 7 then concat(cast(cust % 4 as string), ' - ', cast(cust % 3 as string))"
    " else case cust % 2 when 0 then 'over' else 'under' end end AS selection",
    "case match_id % 9 when 2 then 1.5 + cust % 3 when 3 then cast(3 + cust % 4 as double)"
    " when 4 then 8.5 + cust % 3 when 6 then case when cust % 10 = 0 then 1.0E0 else cust % 3 - 1.5 end end AS line",
    "case cust % 4 when 0 then '+150' when 1 then '-120' when 2 then '5/2' else '1,85' end AS odds_text",
    "case cust % 3 when 0 then '$100' when 1 then '1,000' else '50' end AS stake_text",
    "case when match_id % 4 = 1 then concat('K', cast(cust as string), '-', cast(season as string)) end AS combo_id",
    "played",
])


def _tables(name: str, seen: list[str]) -> list[str]:
    if name == "p1":
        _tables("p0", seen)
    elif name in _STEPS:
        _tables(_STEPS[name][0], seen)
    if name not in seen and (name in _STEPS or name == "p1"):
        seen.append(name)
    return seen


def ctes(*names: str) -> str:
    """The views as text for a WITH clause (dependencies included)."""
    order: list[str] = []
    for n in names:
        _tables(n, order)
    parts = []
    for n in order:
        if n == "p1":
            parts.append(f"p1 AS (SELECT {', '.join(_PANEL_KEYS + _PANEL_COUNTS)} FROM p0 "
                         f"GROUP BY {', '.join(_PANEL_KEYS)})")
            continue
        source, exprs, where = _STEPS[n]
        text = ", ".join(exprs)
        if n == "e0":
            text = text.replace("unix_day", "date_diff('day', date '1970-01-01', cast(ts as date))").replace(
                "unix_minute", "cast(hour(ts) * 60 + minute(ts) as bigint)")
        tail = f" WHERE {where}" if where else ""
        parts.append(f"{n} AS (SELECT {text} FROM {source}{tail})")
    return ",\n".join(parts)


def view(spark: SparkSession, sf_dir: str, name: str, stream: bool = False, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """The view `name` over the tables in `sf_dir`, as a batch or as a file stream; `known` has views built already."""
    if known and name in known:
        return known[name]
    if name == "p1":
        return view(spark, sf_dir, "p0").groupBy(*_PANEL_KEYS).agg(*[F.expr(e) for e in _PANEL_COUNTS])
    if name not in _STEPS:
        if not stream:
            return table(spark, sf_dir, name)
        schema = table(spark, sf_dir, name).schema
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    source, exprs, where = _STEPS[name]
    df = view(spark, sf_dir, source, stream, known)
    if name == "e0":
        exprs = [e.replace("unix_day", "unix_date(cast(ts as date))").replace(
            "unix_minute", "cast(hour(ts) * 60 + minute(ts) as bigint)") for e in exprs]
    if where:
        df = df.filter(where)
    return df.selectExpr(*exprs)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The raw panel with repeated rows: the same content again under another id.
RAW_PANEL_SQL = """v_panel AS (
  SELECT ranker * 10 + c AS ranker, player, nationality, position, team, league, season, age, birth_year, games,
    games_starts, minutes, minutes_90s, goals, assists, pens_made, pens_att, cards_yellow, cards_red, goals_assists,
    goals_pens, case when c = 2 then concat('f', substr(hid, 2, 7)) else player_id end AS player_id, team_id
  FROM (SELECT *, unnest(range(1, copies + 1)) AS c FROM p3))"""


def raw_panel(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """The raw player panel, defects included (see RAW_PANEL_SQL for the same rows in SQL)."""
    return (view(spark, sf_dir, "p3", known=known)
            .selectExpr("*", "explode(sequence(1, copies)) AS c")
            .selectExpr("ranker * 10 + c AS ranker", "player", "nationality", "position", "team", "league",
                        "season", "age", "birth_year", "games", "games_starts", "minutes", "minutes_90s",
                        "goals", "assists", "pens_made", "pens_att", "cards_yellow", "cards_red",
                        "goals_assists", "goals_pens",
                        "case when c = 2 then concat('f', substr(hid, 2, 7)) else player_id end AS player_id",
                        "team_id"))
