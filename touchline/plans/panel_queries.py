"""Queries over the player panel: audit, identity, season totals, fantasy points, squads and leagues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import r6
from touchline.operators import fantasy, league, panel
from touchline.operators.ranking import gini
from touchline.plans.registry import query
from touchline.plans.views import RAW_PANEL_SQL, ctes, raw_panel, view
from touchline.session import stored

ALIASES = {"00000033": "00000032"}
NAMESAKES = ["jugador-100|1980|N4"]
LEAGUES = [f"LG{i}" for i in range(5)]
LOCALS = {f"LG{i}": [f"N{i}"] for i in range(5)}
SUMMER = ["LG0"]
MIN_MINUTES = 600.0


def counted(spark, sf) -> dict[str, DataFrame]:
    """Player-team-season counts, fewer rows than the lines they come from: scanned and written once for all panel views."""
    return {"p1": stored(view(spark, sf, "p1"))}


def shared(spark, sf) -> dict[str, DataFrame]:
    """The counts and the clean panel, for queries that read the panel in several ways."""
    known = counted(spark, sf)
    return known | {"clean": cleaned(spark, sf, known)}


def cleaned(spark, sf, known=None) -> DataFrame:
    return panel.clean(raw_panel(spark, sf, known or counted(spark, sf)), ALIASES)


def full_rows(spark, sf, known=None) -> DataFrame:
    known = known or shared(spark, sf)
    return panel.with_extras(known["clean"], *[view(spark, sf, v, known=known) for v in ("v_playingtime", "v_keepers")])


def seasons(spark, sf, known=None) -> DataFrame:
    return panel.by_season(full_rows(spark, sf, known))


def scored(spark, sf, known=None) -> DataFrame:
    return fantasy.defensive_points(fantasy.offensive_points(seasons(spark, sf, known)))


#: What the ranking reads; what moves and squads read besides.
_RANKING = [*fantasy.PEERS, "minutes", "complete", "pts_complete_per_matchday"]
_OF_PLAYER = ["player_key", "season_start", "main_team_id"]


def ranked(spark, sf, columns: list[str] | None = None, known=None) -> DataFrame:
    """Points with percentiles; `columns` names those asked for besides the ranking's own, all others are not worked out at all."""
    # points are read several times by the ranking: written once to the shared folder
    points = scored(spark, sf, known)
    points = points if columns is None else points.select(*_RANKING, *columns)
    return fantasy.complete_percentile(stored(points), min_minutes=MIN_MINUTES)


def teams(spark, sf, known=None) -> DataFrame:
    return league.team_summary(full_rows(spark, sf, known), LOCALS)


def moves(spark, sf) -> DataFrame:
    return league.ladder_moves(ranked(spark, sf, _OF_PLAYER), LEAGUES, MIN_MINUTES)


def _round(df: DataFrame, keep: list[str], numbers: list[str]) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(c) for c in numbers])


# --- checking SQL for the shared stages -----------------------------------------------------------------------------

NAME_KEY = ("concat(trim(regexp_replace(lower(strip_accents(player)), '[^a-z0-9]+', '-', 'g'), '-'), '|', "
            "coalesce(cast(cast(birth_year as bigint) as string), 'na'), '|', split_part(nationality, ' ', 2))")
CONTENT = ("player, nationality, position, team, league, season, age, birth_year, games, games_starts, minutes, minutes_90s, "
           "goals, assists, pens_made, pens_att, cards_yellow, cards_red, goals_assists, goals_pens")
TYPED = f"""{ctes('v_playingtime', 'v_keepers')},
{RAW_PANEL_SQL},
ty AS (SELECT * REPLACE (try_cast(replace(minutes, ',', '') as double) AS minutes), {NAME_KEY} AS name_key FROM v_panel)"""
CLEAN = f"""{TYPED},
dd AS (SELECT * FROM ty QUALIFY row_number() OVER (PARTITION BY {CONTENT} ORDER BY ranker) = 1),
c1 AS (SELECT ranker, player, league, season, team, team_id, player_id, position, birth_year, games, games_starts,
  coalesce(minutes, round(coalesce(minutes_90s, 0) * 90)) AS minutes, goals, coalesce(assists, 0) AS assists, pens_made,
  greatest(coalesce(pens_att, 0), pens_made) AS pens_att, cards_yellow, cards_red,
  case when player_id = '00000033' then '00000032' else player_id end AS player_key, split_part(nationality, ' ', 2) AS country,
  split_part(position, ',', 1) AS main_position, cast(substr(season, 1, 4) as bigint) AS season_start,
  cast(split_part(age, '-', 1) as double) AS age FROM dd),
nr AS (SELECT league, season, max(games) AS league_games FROM c1 GROUP BY ALL),
nq AS (SELECT *, league_games < 0.6 * max(league_games) OVER (PARTITION BY league) AS partial_season FROM nr),
cl AS (SELECT *, not regexp_full_match(player_key, '[0-9a-f]{{8}}') AS provisional_id, goals + assists AS goals_assists,
  goals - pens_made AS goals_pens FROM c1 JOIN nq USING (league, season))"""
FULL = f"""{CLEAN},
fr AS (SELECT cl.*, p.* EXCLUDE (league, season, player_id, team_id), k.* EXCLUDE (league, season, player_id, team_id) FROM cl
  LEFT JOIN v_playingtime p ON p.league = cl.league AND p.season = cl.season AND p.player_id = cl.player_id AND p.team_id = cl.team_id
  LEFT JOIN v_keepers k ON k.league = cl.league AND k.season = cl.season AND k.player_id = cl.player_id AND k.team_id = cl.team_id)"""
_SUMS = ", ".join(f"sum({c}) AS {c}" for c in panel.COUNTS + panel.PLAYINGTIME_SUMS + panel.KEEPER_SUMS)
SEASON = f"""{FULL},
rk AS (SELECT *, row_number() OVER (PARTITION BY player_key, league, season ORDER BY minutes DESC, ranker) AS rn FROM fr),
js AS (SELECT player_key, league, season, max(case when rn = 1 then player end) AS player, max(case when rn = 1 then main_position end) AS main_position,
  max(case when rn = 1 then age end) AS age, max(season_start) AS season_start, max(league_games) AS league_games, bool_or(partial_season) AS partial_season,
  max(case when rn = 1 then team end) AS main_team, max(case when rn = 1 then team_id end) AS main_team_id,
  string_agg(team, ' / ' ORDER BY rn) AS teams, count(DISTINCT team) AS n_teams, {_SUMS},
  sum(case when points_per_game is not null and games > 0 then points_per_game * games end) / nullif(sum(case when points_per_game is not null and games > 0 then games end), 0) AS points_per_game,
  sum(case when plus_minus_wowy is not null and minutes > 0 then plus_minus_wowy * minutes end) / nullif(sum(case when plus_minus_wowy is not null and minutes > 0 then minutes end), 0) AS plus_minus_wowy
  FROM rk GROUP BY player_key, league, season),
jt AS (SELECT *, case when minutes > 0 then (goals - pens_made) / (minutes / 90) end AS goals_pens_per90,
  100 * gk_saves / nullif(gk_shots_on_target_against, 0) AS gk_save_pct, 100 * gk_clean_sheets / nullif(gk_games, 0) AS gk_clean_sheets_pct FROM js)"""
_GOAL = "case main_position when 'GK' then 6 when 'DF' then 6 when 'MF' then 5 when 'FW' then 4 else 5 end"
_CS = "case main_position when 'GK' then 4 when 'DF' then 4 when 'MF' then 1 when 'FW' then 0 else 1 end"
_CON = "case main_position when 'GK' then -1 when 'DF' then -1 else 0 end"


def _floor_sql(lam: str, d: int) -> str:
    return (f"case when {lam} > 0 then list_sum(list_transform(range(40), lambda k: exp(-({lam}) + k * ln({lam}) - lgamma(k + 1)) * (k // {d})))"
            f" when {lam} is not null then 0 end")


SCORED = f"""{SEASON},
of AS (SELECT *, 2 * games_starts + (games - games_starts) AS pts_appearance, {_GOAL} * goals AS pts_goals, 3 * assists AS pts_assists,
  -1 * cards_yellow - 3 * cards_red AS pts_cards, -2 * greatest(pens_att - pens_made, 0) AS pts_penalties,
  coalesce(gk_minutes, 0) > 0 AS gk FROM jt),
o2 AS (SELECT *, pts_appearance + pts_goals + pts_assists + pts_cards + pts_penalties AS pts_total,
  case when gk then gk_games else games end AS n, case when gk then gk_goals_against else on_goals_against end AS c,
  case when gk then gk_clean_sheets when on_goals_against is not null and minutes > 0
    then games_starts * power(greatest((minutes / 90 - 1) / (minutes / 90), 0), on_goals_against) end AS clean_sheets FROM of),
o3 AS (SELECT *, case when n > 0 then c / n else 0 end AS cr, case when n > 0 then coalesce(gk_saves, 0) / n else 0 end AS sr FROM o2),
o4 AS (SELECT *, {_CS} * clean_sheets AS pts_clean_sheets, case when c is not null then {_CON} * ({_floor_sql('cr', 2)}) * n end AS pts_conceded,
  case when gk and gk_saves is not null then ({_floor_sql('sr', 3)}) * n end AS pts_saves, case when gk then 5 * gk_pens_saved end AS pts_penalties_saved,
  case when gk then gk_clean_sheets is not null and gk_goals_against is not null and gk_saves is not null and gk_pens_saved is not null
    else on_goals_against is not null end AS complete FROM o3),
sc AS (SELECT *, coalesce(pts_clean_sheets, 0) + coalesce(pts_conceded, 0) + coalesce(pts_saves, 0) + coalesce(pts_penalties_saved, 0) AS pts_defensive,
  pts_total + coalesce(pts_clean_sheets, 0) + coalesce(pts_conceded, 0) + coalesce(pts_saves, 0) + coalesce(pts_penalties_saved, 0) AS pts_complete,
  (pts_total + coalesce(pts_clean_sheets, 0) + coalesce(pts_conceded, 0) + coalesce(pts_saves, 0) + coalesce(pts_penalties_saved, 0)) / league_games AS pts_complete_per_matchday,
  pts_total / league_games AS pts_per_matchday FROM o4)"""


def _pct_sql(value: str, where: str) -> str:
    return (f"SELECT player_key, league, season, 100.0 * (rank() OVER (PARTITION BY league, season, main_position ORDER BY v)"
            f" + (count(*) OVER (PARTITION BY league, season, main_position, v) - 1) / 2.0) / count(*) OVER (PARTITION BY league, season, main_position) AS pct"
            f" FROM (SELECT *, {value} AS v FROM sc WHERE {where})")


RANKED = f"""{SCORED},
pz AS ({_pct_sql('pts_complete_per_matchday', f'complete AND minutes >= {MIN_MINUTES}')}),
rj AS (SELECT sc.*, pct AS pct_complete FROM sc LEFT JOIN pz USING (player_key, league, season))"""
_OK = "abs(coalesce(w, 0) + coalesce(t, 0) + coalesce(l, 0) - games) <= 1 AND games > 0"
TEAMS = f"""{FULL},
fx AS (SELECT * FROM fr WHERE NOT partial_season),
cu AS (SELECT league, season, team_id, minutes, sum(minutes) OVER (PARTITION BY league, season, team_id ORDER BY minutes DESC, ranker) AS cum,
  row_number() OVER (PARTITION BY league, season, team_id ORDER BY minutes DESC, ranker) AS rn, sum(minutes) OVER (PARTITION BY league, season, team_id) AS tot FROM fx),
p80 AS (SELECT league, season, team_id, coalesce(min(case when tot > 0 and cum >= (0.8 - 1e-12) * tot then rn end), 0) AS players_80 FROM cu GROUP BY ALL),
t1 AS (SELECT league, season, team_id, min(season_start) AS season_start, count_if(minutes > 0) AS players_used,
  sum(case when minutes > 0 then age * minutes end) / nullif(sum(case when minutes > 0 then minutes end), 0) AS weighted_age,
  100 * sum(case when country <> replace(league, 'LG', 'N') then minutes else 0 end) / nullif(sum(minutes), 0) AS foreign_pct,
  100 * sum(case when age <= 21 then minutes else 0 end) / nullif(sum(minutes), 0) AS under21_pct, sum(minutes) AS minutes,
  round(sum(coalesce(gk_minutes, 0)) / 90) AS games, sum(gk_wins) AS w, sum(gk_ties) AS t, sum(gk_losses) AS l, sum(goals) AS goals,
  arg_max(player, row(goals, -ranker)) AS top_scorer, max(goals) AS top_goals FROM fx GROUP BY ALL),
ts AS (SELECT * EXCLUDE (w, t, l), {_OK} AS reliable, case when {_OK} then coalesce(w, 0) end AS wins, case when {_OK} then coalesce(t, 0) end AS ties,
  case when {_OK} then 3 * coalesce(w, 0) + coalesce(t, 0) end AS points, case when {_OK} then (3 * coalesce(w, 0) + coalesce(t, 0)) / games end AS ppm,
  top_goals / nullif(goals, 0) AS dependence FROM t1 JOIN p80 USING (league, season, team_id))"""


def _r(names, prefix=""):
    return ", ".join(f"round({prefix}{n}, 6) AS {n}" for n in names)


def _corr_sql(x: str, y: str, cond: str = "true", min_n: int = 3) -> str:
    f = f"FILTER (WHERE ({cond}) AND {x} IS NOT NULL AND {y} IS NOT NULL)"
    return (f"round(case when count(*) {f} >= {min_n} then covar_pop({x}, {y}) {f} / nullif(stddev_pop({x}) {f} * stddev_pop({y}) {f}, 0) end, 6)")


# --- quality and identity -------------------------------------------------------------------------------------------

@query("panel_audit", f"""WITH {CLEAN.replace('cl AS', 'clx AS')},
ky AS (SELECT *, case when player_id = '00000033' then '00000032' else player_id end AS player_key FROM ty),
cand AS (SELECT name_key, count(DISTINCT player_id) AS ids, bool_or(player_id IN ('00000033', '00000032')) AS al FROM ty GROUP BY name_key HAVING count(DISTINCT player_id) > 1),
st AS (SELECT case when al then 'alias' when name_key = '{NAMESAKES[0]}' then 'namesakes' else 'pending' end AS state FROM cand),
nm AS (SELECT league, season, max(games) AS lgm FROM ty GROUP BY ALL),
im AS (SELECT player_key, season FROM ky JOIN nm USING (league, season) GROUP BY player_key, league, season HAVING sum(games) > max(lgm) + 1
  UNION ALL SELECT player_key, season FROM ky JOIN nm USING (league, season) WHERE league <> 'LG0' GROUP BY player_key, season
    HAVING count(DISTINCT league) > 1 AND sum(games) > max(lgm) + 1)
SELECT 'empty minutes' AS "check", 'error' AS kind, count_if(minutes IS NULL) AS cases FROM ty UNION ALL
SELECT 'other empty count', 'error', count_if(minutes IS NOT NULL AND assists IS NULL) FROM ty UNION ALL
SELECT 'goals and assists do not add up', 'error', count_if(NOT coalesce(goals_assists = goals + assists, false)) FROM ty UNION ALL
SELECT 'goals without penalties do not add up', 'error', count_if(NOT coalesce(goals_pens = goals - pens_made, false)) FROM ty UNION ALL
SELECT 'more penalties scored than taken', 'error', count_if(pens_made > pens_att) FROM ty UNION ALL
SELECT 'row without id', 'error', count_if(player_id IS NULL) FROM ty UNION ALL
SELECT 'player without own page', 'context', count_if(NOT regexp_full_match(player_id, '[0-9a-f]{{8}}')) FROM ty UNION ALL
SELECT 'empty birth year', 'context', count_if(birth_year IS NULL) FROM ty UNION ALL
SELECT 'repeated row', 'error', (SELECT count(*) FROM ty) - (SELECT count(*) FROM dd) UNION ALL
SELECT 'same name, several birth years in a league season', 'structure', count(*) FROM (SELECT 1 FROM ty GROUP BY league, season, player HAVING count(DISTINCT birth_year) > 1) UNION ALL
SELECT 'same name key, different people', 'structure', count_if(state = 'namesakes') FROM st UNION ALL
SELECT 'one person, two ids', 'error', count_if(state = 'alias') FROM st UNION ALL
SELECT 'identity candidates not reviewed', 'structure', count_if(state = 'pending') FROM st UNION ALL
SELECT 'more games than a season holds', 'error', count(*) FROM im UNION ALL
SELECT 'several teams in one league season', 'structure', count(*) FROM (SELECT 1 FROM ky GROUP BY player_key, league, season HAVING count(DISTINCT team) > 1) UNION ALL
SELECT 'several leagues in one season', 'context', count(*) FROM (SELECT 1 FROM ky GROUP BY player_key, season HAVING count(DISTINCT league) > 1) UNION ALL
SELECT 'shortened league season', 'context', count(*) FROM (SELECT 1 FROM ty GROUP BY league, season HAVING max(games) < 2 * (count(DISTINCT team) - 1))""")
def panel_audit(spark, sf):
    return panel.audit(raw_panel(spark, sf), ALIASES, NAMESAKES, SUMMER).drop("example")


@query("panel_clean", f"""WITH {CLEAN} SELECT player_key, league, season, team_id, minutes, assists, pens_att, goals_assists, goals_pens,
round(case when minutes > 0 then goals / (minutes / 90) end, 6) AS goals_per90, provisional_id, country, main_position, season_start, age, league_games, partial_season FROM cl""")
def panel_clean(spark, sf):
    return cleaned(spark, sf).select(
        "player_key", "league", "season", "team_id", "minutes", "assists", "pens_att", "goals_assists", "goals_pens",
        r6("goals_per90").alias("goals_per90"), "provisional_id", "country", "main_position", "season_start", "age",
        "league_games", "partial_season")


@query("identity_candidates", f"""WITH {TYPED},
pr AS (SELECT name_key, player_id, arg_min(player, ranker) AS player, min(season) AS since, max(season) AS until, count(DISTINCT team) AS teams FROM ty GROUP BY ALL),
sv AS (SELECT name_key, count(*) AS ids FROM pr GROUP BY name_key HAVING count(*) > 1)
SELECT name_key, player_id, player, since, until, teams, ids, case when player_id IN ('00000033', '00000032') then 'alias' when name_key = '{NAMESAKES[0]}' then 'namesakes'
  else 'pending' end AS state FROM pr JOIN sv USING (name_key)""")
def identity_candidates(spark, sf):
    return panel.identity_candidates(raw_panel(spark, sf), ALIASES, NAMESAKES).drop("position")


@query("impossible_totals", f"""WITH {CLEAN}
SELECT player_key, season, 'same league' AS rule, sum(games) AS games, max(league_games) AS possible FROM cl GROUP BY player_key, league, season HAVING sum(games) > max(league_games) + 1
UNION ALL SELECT player_key, season, 'across leagues', sum(games), max(league_games) FROM cl WHERE league <> 'LG0' GROUP BY player_key, season
HAVING count(DISTINCT league) > 1 AND sum(games) > max(league_games) + 1""")
def impossible_totals(spark, sf):
    return panel.impossible_totals(cleaned(spark, sf), SUMMER)


@query("consolidation_evidence", f"""WITH {TYPED},
sp AS (SELECT name_key, player_id, min(season) AS since, max(season) AS until FROM ty GROUP BY ALL),
m AS (SELECT *, max(until) OVER (PARTITION BY name_key ORDER BY since, until, player_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pu FROM sp)
SELECT name_key, count(*) AS labels, cast(sum(coalesce(since <= pu, false)::int) as bigint) AS overlaps, min(since) AS since, max(until) AS until FROM m GROUP BY name_key HAVING count(*) > 1""")
def consolidation_evidence(spark, sf):
    from touchline.functions.text import name_key

    d = raw_panel(spark, sf).withColumn("name_key", name_key("player", "birth_year", "nationality"))
    return panel.consolidation_evidence(d, "name_key", "player_id", "season")


_COVER = ["minutes", "assists", "birth_year", "on_goals_against", "plus_minus_wowy", "gk_saves", "gk_pens_saved"]


@query("coverage_by_season", f"""WITH {FULL}, w AS (SELECT league, season_start, {', '.join(f'round(100.0 * avg(({c} is not null)::int), 6) AS {c}' for c in _COVER)} FROM fr GROUP BY ALL)
SELECT league, season_start, "column", filled FROM (UNPIVOT w ON {', '.join(_COVER)} INTO NAME "column" VALUE filled)""")
def coverage_by_season(spark, sf):
    return panel.coverage(full_rows(spark, sf), ["league", "season_start"], _COVER).withColumn("filled", r6("filled"))


@query("available_since", f"""WITH {FULL}, w AS (SELECT league, season_start, {', '.join(f'100.0 * avg(({c} is not null)::int) AS {c}' for c in _COVER)} FROM fr GROUP BY ALL),
u AS (SELECT * FROM (UNPIVOT w ON {', '.join(_COVER)} INTO NAME "column" VALUE filled))
SELECT league, "column", min(case when filled >= 90 then season_start end) AS available_since FROM u GROUP BY league, "column" """)
def available_since(spark, sf):
    cover = panel.coverage(full_rows(spark, sf), ["league", "season_start"], _COVER)
    return panel.available_since(cover, "season_start", ["league"])


@query("player_season", f"""WITH {SEASON} SELECT player_key, league, season, player, main_position, main_team, teams, n_teams, games, minutes, goals, assists, pens_att,
{_r(['goals_pens_per90', 'points_per_game', 'plus_minus_wowy', 'gk_save_pct', 'gk_clean_sheets_pct'])}, on_goals_for, on_goals_against, gk_saves,
round(least(1, minutes / (league_games * 90)), 6) AS minutes_share FROM jt""")
def player_season(spark, sf):
    return _round(seasons(spark, sf), ["player_key", "league", "season", "player", "main_position", "main_team", "teams",
                                       "n_teams", "games", "minutes", "goals", "assists", "pens_att", "on_goals_for",
                                       "on_goals_against", "gk_saves"],
                  ["goals_pens_per90", "points_per_game", "plus_minus_wowy", "gk_save_pct", "gk_clean_sheets_pct",
                   "minutes_share"])


@query("keeper_source_disagreement", f"""WITH {SEASON} SELECT season_start, cast(sum((gk_goals_against <> on_goals_against)::int) as bigint) AS disagree, count(*) AS keepers
FROM jt WHERE gk_games is not null AND on_goals_against is not null GROUP BY season_start""")
def keeper_source_disagreement(spark, sf):
    return panel.source_disagreement(seasons(spark, sf))


# --- fantasy --------------------------------------------------------------------------------------------------------

@query("fantasy_offense", f"""WITH {SCORED} SELECT player_key, league, season, pts_appearance, pts_goals, pts_assists, pts_cards, pts_penalties, pts_total,
{_r(['pts_per_matchday'])}, round(case when minutes > 0 then pts_total / (minutes / 90) end, 6) AS pts_per90 FROM sc""")
def fantasy_offense(spark, sf):
    out = fantasy.offensive_points(seasons(spark, sf))
    return _round(out, ["player_key", "league", "season", "pts_appearance", "pts_goals", "pts_assists", "pts_cards",
                        "pts_penalties", "pts_total"], ["pts_per_matchday", "pts_per90"])


_DEF = ["clean_sheets", "pts_clean_sheets", "pts_conceded", "pts_saves", "pts_penalties_saved", "pts_defensive",
        "pts_complete", "pts_complete_per_matchday"]


@query("fantasy_defense", f"WITH {SCORED} SELECT player_key, league, season, complete, {_r(_DEF)} FROM sc")
def fantasy_defense(spark, sf):
    return _round(scored(spark, sf), ["player_key", "league", "season", "complete"], _DEF)


@query("fantasy_percentile", f"""WITH {RANKED}, po AS ({_pct_sql('pts_per_matchday', f'minutes >= {MIN_MINUTES}')})
SELECT player_key, league, season, round(pct_complete, 6) AS pct_complete, round(po.pct, 6) AS pct_offensive FROM rj LEFT JOIN po USING (player_key, league, season)""")
def fantasy_percentile(spark, sf):
    out = fantasy.peer_percentile(ranked(spark, sf), "pts_per_matchday", "pct_offensive", MIN_MINUTES)
    return _round(out, ["player_key", "league", "season"], ["pct_complete", "pct_offensive"])


@query("fantasy_consistency", f"""WITH {RANKED}, d AS (SELECT * FROM rj WHERE pct_complete is not null),
md AS (SELECT player_key, main_position, count(*) AS c FROM d GROUP BY ALL)
SELECT player_key, (SELECT main_position FROM md WHERE md.player_key = d.player_key ORDER BY c DESC, main_position LIMIT 1) AS position, count(*) AS seasons,
  array_to_string(list_sort(list_distinct(list(league))), ' / ') AS leagues, round(avg(pct_complete), 6) AS pct_mean, round(min(pct_complete), 6) AS pct_min,
  round(max(pct_complete), 6) AS pct_max, round(stddev_samp(pct_complete), 6) AS pct_sd, min(season_start) AS since, max(season_start) AS until
FROM d GROUP BY player_key HAVING count(*) >= 3""")
def fantasy_consistency(spark, sf):
    out = fantasy.consistency(ranked(spark, sf), "pct_complete", 3).drop("player")
    return _round(out, ["player_key", "position", "seasons", "leagues", "since", "until"],
                  ["pct_mean", "pct_min", "pct_max", "pct_sd"])


_VAL = """count(*) AS keepers, round(avg(gk_clean_sheets), 6) AS "real", round(avg(e), 6) AS estimated, round(avg(e - gk_clean_sheets), 6) AS bias,
  round(avg(abs(e - gk_clean_sheets)), 6) AS mae, round(covar_pop(e, gk_clean_sheets) / nullif(stddev_pop(e) * stddev_pop(gk_clean_sheets), 0), 6) AS r"""


@query("clean_sheet_validation", f"""WITH {SEASON}, g AS (SELECT gk_clean_sheets, gk_games_starts * power(greatest((gk_minutes / 90 - 1) / (gk_minutes / 90), 0), gk_goals_against) AS e,
  case when gk_games <= 5 then '1-5' when gk_games <= 15 then '6-15' when gk_games <= 25 then '16-25' else '26+' end AS band
  FROM jt WHERE gk_games > 0 AND gk_clean_sheets is not null AND gk_goals_against is not null)
SELECT band, {_VAL} FROM g GROUP BY band UNION ALL SELECT 'ALL', {_VAL} FROM g""")
def clean_sheet_validation(spark, sf):
    return _round(fantasy.clean_sheet_validation(seasons(spark, sf)), ["band", "keepers"],
                  ["real", "estimated", "bias", "mae", "r"])


_POS = ["pts_total", "pts_clean_sheets", "pts_conceded", "pts_saves", "pts_penalties_saved", "pts_complete"]


@query("points_by_position", f"""WITH {SCORED} SELECT main_position, count(*) AS seasons, {', '.join(f'round(avg(coalesce({p}, 0)), 6) AS {p}' for p in _POS)}
FROM sc WHERE complete AND minutes >= {MIN_MINUTES} GROUP BY main_position""")
def points_by_position(spark, sf):
    return _round(fantasy.points_by_position(scored(spark, sf), MIN_MINUTES), ["main_position", "seasons"], _POS)


@query("floor_comparison", f"""WITH {SCORED} SELECT league, count(*) AS keepers, round(avg(gk_saves / 3), 6) AS saves_divided, round(avg(pts_saves), 6) AS saves_per_match,
round(avg(-gk_goals_against / 2), 6) AS conceded_divided, round(avg(pts_conceded), 6) AS conceded_per_match FROM sc WHERE gk AND gk_games > 0 GROUP BY league""")
def floor_comparison(spark, sf):
    return _round(fantasy.floor_comparison(scored(spark, sf)), ["league", "keepers"],
                  ["saves_divided", "saves_per_match", "conceded_divided", "conceded_per_match"])


# --- squads and leagues ---------------------------------------------------------------------------------------------

_TEAM_N = ["weighted_age", "foreign_pct", "under21_pct", "ppm", "dependence"]


@query("team_season_summary", f"""WITH {TEAMS} SELECT league, season, team_id, players_used, players_80, minutes, games, reliable, wins, ties, points, goals, top_scorer, top_goals, {_r(_TEAM_N)} FROM ts""")
def team_season_summary(spark, sf):
    return _round(teams(spark, sf), ["league", "season", "team_id", "players_used", "players_80", "minutes", "games",
                                     "reliable", "wins", "ties", "points", "goals", "top_scorer", "top_goals"], _TEAM_N)


_TREND = ["players_80", "foreign_pct", "under21_pct", "weighted_age", "dependence"]


@query("season_trend", f"""WITH {TEAMS} SELECT league, season_start, {', '.join(f'round(quantile_cont({c}, {q}), 6) AS {c}_{n}' for c in _TREND for q, n in ((0.25, 'p25'), (0.5, 'median'), (0.75, 'p75')))} FROM ts GROUP BY ALL""")
def season_trend(spark, sf):
    out = league.season_trend(teams(spark, sf), _TREND)
    return _round(out, ["league", "season_start"], [f"{c}_{q}" for c in _TREND for q in ("p25", "median", "p75")])


@query("keeper_totals", f"""WITH {SEASON}, t AS (SELECT league, season_start, sum(gk_saves) AS s, sum(gk_shots_on_target_against) AS h, sum(gk_goals_against) AS a, sum(gk_clean_sheets) AS c, sum(gk_games) AS g
FROM jt WHERE gk_games is not null AND NOT partial_season GROUP BY ALL)
SELECT league, season_start, round(100 * s / nullif(h, 0), 6) AS save_pct, round(a / g, 6) AS conceded_per_match, round(100 * c / g, 6) AS clean_sheet_pct FROM t""")
def keeper_totals(spark, sf):
    return _round(league.keeper_totals(seasons(spark, sf)), ["league", "season_start"],
                  ["save_pct", "conceded_per_match", "clean_sheet_pct"])


@query("keeper_careers", f"""WITH {SEASON} SELECT league, player_key, count(DISTINCT season) AS seasons, min(season_start) AS since, max(season_start) AS until, sum(gk_minutes) AS minutes,
sum(gk_games) AS games, round(100 * sum(gk_saves) / nullif(sum(gk_shots_on_target_against), 0), 6) AS save_pct, round(100 * sum(gk_clean_sheets) / sum(gk_games), 6) AS clean_sheet_pct,
round(sum(gk_goals_against) / (sum(gk_minutes) / 90), 6) AS conceded_per90 FROM jt WHERE gk_games is not null GROUP BY ALL HAVING sum(gk_minutes) >= 900""")
def keeper_careers(spark, sf):
    return _round(league.keeper_careers(seasons(spark, sf), 900), ["league", "player_key", "seasons", "since", "until",
                                                                  "minutes", "games"],
                  ["save_pct", "clean_sheet_pct", "conceded_per90"])


@query("top_fantasy_per_team", f"""WITH {SCORED}, b AS (SELECT league, season_start, main_team_id, player_key, pts_total, sum(pts_total) OVER (PARTITION BY league, season_start, main_team_id) AS team_points,
row_number() OVER (PARTITION BY league, season_start, main_team_id ORDER BY pts_total DESC, player_key) AS rn FROM sc)
SELECT league, season_start, main_team_id, player_key, pts_total, team_points, round(pts_total / nullif(team_points, 0), 6) AS team_share FROM b WHERE rn = 1""")
def top_fantasy_per_team(spark, sf):
    return league.best_fantasy_per_team(scored(spark, sf)).withColumn("team_share", r6("team_share"))


def _pairs_sql(src: str, keys: str, values: list[str], minutes: str, cond: str) -> str:
    x = f"(SELECT {keys}, season_start, {', '.join(values)} FROM {src} WHERE {minutes} >= {MIN_MINUTES} AND {cond})"
    nxt = ", ".join(f"y.{v} AS {v}_next" for v in values)
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    return f"SELECT x.*, {nxt} FROM {x} x JOIN {x} y ON {on} AND y.season_start = x.season_start + 1"


@query("stability", f"""WITH {SEASON}, pr AS ({_pairs_sql('jt', 'league, player_key', ['goals_pens_per90'], 'minutes', 'goals_pens_per90 is not null')})
SELECT league, {_corr_sql('goals_pens_per90', 'goals_pens_per90_next')} AS r, count(*) AS pairs FROM pr GROUP BY league""")
def stability(spark, sf):
    return league.stability(seasons(spark, sf), ["league"], "goals_pens_per90", MIN_MINUTES).withColumn("r", r6("r"))


@query("mean_stability", f"""WITH {SEASON}, pa AS ({_pairs_sql('jt', 'league, main_position, player_key', ['goals_pens_per90'], 'minutes', 'goals_pens_per90 is not null')}),
pb AS ({_pairs_sql('jt', 'league, main_position, player_key', ['points_per_game'], 'minutes', 'points_per_game is not null')}),
a AS (SELECT league, main_position, {_corr_sql('goals_pens_per90', 'goals_pens_per90_next')} AS a FROM pa GROUP BY ALL),
b AS (SELECT league, main_position, {_corr_sql('points_per_game', 'points_per_game_next')} AS b FROM pb GROUP BY ALL)
SELECT main_position, round(avg(a), 4) AS stability_goals_pens_per90, round(avg(b), 4) AS stability_points_per_game, count_if(b > a) AS rises_in
FROM a FULL JOIN b USING (league, main_position) GROUP BY main_position""")
def mean_stability(spark, sf):
    out = league.mean_stability(seasons(spark, sf), "league", ["main_position"], "goals_pens_per90", "points_per_game", MIN_MINUTES)
    return out.select("main_position", *[F.round(c, 4).alias(c) for c in ("stability_goals_pens_per90", "stability_points_per_game")], "rises_in")


@query("minutes_coverage", f"""WITH {TEAMS} SELECT season, count(*) AS teams, quantile_cont(games, 0.5) AS median_games, round(min(minutes / nullif(games * 990, 0)), 6) AS least_coverage
FROM ts GROUP BY season""")
def minutes_coverage(spark, sf):
    return league.minutes_coverage(teams(spark, sf)).withColumn("least_coverage", r6("least_coverage"))


@query("clean_sheet_origin", f"""WITH {SCORED}, d AS (SELECT *, clean_sheets / nullif(games, 0) AS rate FROM sc WHERE complete),
pr AS ({_pairs_sql('d', 'player_key, main_position', ['rate', 'main_team_id'], 'minutes', 'rate is not null')})
SELECT main_position, {_corr_sql('rate', 'rate_next', 'main_team_id = main_team_id_next')} AS r_stayed, count_if(main_team_id = main_team_id_next) AS n_stayed,
{_corr_sql('rate', 'rate_next', 'main_team_id <> main_team_id_next')} AS r_moved, count_if(main_team_id <> main_team_id_next) AS n_moved FROM pr GROUP BY main_position""")
def clean_sheet_origin(spark, sf):
    return _round(league.clean_sheet_origin(scored(spark, sf), MIN_MINUTES), ["main_position", "n_stayed", "n_moved"],
                  ["r_stayed", "r_moved"])


def _spearman_sql(src: str, x: str, y: str, name: str) -> str:
    return f"""(SELECT league, count(*) AS pairs, {_corr_sql('rx', 'ry', min_n=2)} AS {name} FROM (SELECT league,
  rank() OVER (PARTITION BY league ORDER BY {x}) + (count(*) OVER (PARTITION BY league, {x}) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY league ORDER BY {y}) + (count(*) OVER (PARTITION BY league, {y}) - 1) / 2.0 AS ry
  FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY league)"""


@query("squad_vs_points", f"""WITH {RANKED}, fx AS{TEAMS.split('fx AS', 1)[1]},
sq AS (SELECT league, season_start, main_team_id AS team_id, round(sum(pct_complete * minutes) / sum(minutes), 9) AS squad_pct, count_if(pct_complete >= 80) AS top_fifth FROM rj WHERE pct_complete is not null GROUP BY ALL),
m AS (SELECT ts.league, round(ts.ppm, 9) AS ppm, squad_pct, top_fifth FROM ts JOIN sq USING (league, season_start, team_id) WHERE ppm is not null)
SELECT a.league, a.pairs AS team_seasons, rho_squad, rho_top_fifth FROM {_spearman_sql('m', 'squad_pct', 'ppm', 'rho_squad')} a
JOIN {_spearman_sql('m', 'top_fifth', 'ppm', 'rho_top_fifth')} b USING (league)""")
def squad_vs_points(spark, sf):
    known = shared(spark, sf)
    out = league.squad_vs_points(teams(spark, sf, known), ranked(spark, sf, _OF_PLAYER, known))
    return _round(out, ["league", "team_seasons"], ["rho_squad", "rho_top_fifth"])


@query("position_comparison", f"""WITH {RANKED}, d AS (SELECT * FROM rj WHERE complete),
t AS (SELECT league, main_position, count(DISTINCT player_key) AS players, count(*) AS seasons, round(avg(pts_total), 6) AS pts_offensive, round(avg(pts_defensive), 6) AS pts_defensive,
  round(avg(pts_complete), 6) AS pts_complete, round(100 * sum(pts_defensive) / nullif(sum(pts_complete), 0), 6) AS defensive_pct,
  round(avg(clean_sheets / nullif(games, 0)), 6) AS clean_sheets_per_match FROM d WHERE minutes >= {MIN_MINUTES} GROUP BY ALL),
a AS (SELECT league, main_position, {_corr_sql('pts_per_matchday', 'pts_per_matchday_next')} AS stability_offensive FROM ({_pairs_sql('d', 'league, main_position, player_key', ['pts_per_matchday'], 'minutes', 'pts_per_matchday is not null')}) GROUP BY ALL),
b AS (SELECT league, main_position, count(*) AS pairs, {_corr_sql('pts_complete_per_matchday', 'pts_complete_per_matchday_next')} AS stability_complete FROM ({_pairs_sql('d', 'league, main_position, player_key', ['pts_complete_per_matchday'], 'minutes', 'pts_complete_per_matchday is not null')}) GROUP BY ALL),
c AS (SELECT league, main_position, {_corr_sql('pct_complete', 'pct_complete_next')} AS stability_percentile FROM ({_pairs_sql('d', 'league, main_position, player_key', ['pct_complete'], 'minutes', 'pct_complete is not null')}) GROUP BY ALL)
SELECT t.*, stability_offensive, stability_complete, stability_percentile, coalesce(pairs, 0) AS pairs FROM t LEFT JOIN a USING (league, main_position)
LEFT JOIN b USING (league, main_position) LEFT JOIN c USING (league, main_position)""")
def position_comparison(spark, sf):
    out = league.position_comparison(ranked(spark, sf), MIN_MINUTES)
    return _round(out, ["league", "main_position", "players", "seasons", "pairs"],
                  ["pts_offensive", "pts_defensive", "pts_complete", "defensive_pct", "clean_sheets_per_match",
                   "stability_offensive", "stability_complete", "stability_percentile"])


@query("league_comparison")
def league_comparison(spark, sf):
    """Rank correlations with points and five stabilities per league (each is checked on its own elsewhere)."""
    known = shared(spark, sf)
    return league.league_comparison(teams(spark, sf, known), seasons(spark, sf, known), MIN_MINUTES)


_MOVES = f"""{RANKED}, pr AS ({_pairs_sql('rj', 'player_key', ['league', 'main_team_id', 'pct_complete'], 'minutes', 'pct_complete is not null')}),
ln AS (SELECT regr_slope(pct_complete_next, pct_complete) AS slope, regr_intercept(pct_complete_next, pct_complete) AS cut FROM pr WHERE league = league_next AND main_team_id <> main_team_id_next),
mv AS (SELECT player_key, season_start, league, league_next, pct_complete, pct_complete_next, cut + slope * pct_complete AS expected,
  pct_complete_next - (cut + slope * pct_complete) AS residual FROM pr, ln WHERE league <> league_next)"""


@query("league_ladder_moves", f"WITH {_MOVES} SELECT player_key, season_start, league, league_next, {_r(['pct_complete', 'pct_complete_next', 'expected', 'residual'])} FROM mv")
def league_ladder_moves(spark, sf):
    out = moves(spark, sf)
    return _round(out, ["player_key", "season_start", "league", "league_next"],
                  ["pct_complete", "pct_complete_next", "expected", "residual"])


@query("league_ladder_cells", f"WITH {_MOVES} SELECT league, league_next, count(*) AS n, round(sum(residual), 6) AS total, round(sum(residual * residual), 4) AS squares FROM mv GROUP BY ALL")
def league_ladder_cells(spark, sf):
    out = league.ladder_cells(moves(spark, sf))
    return out.withColumns({"total": r6("total"), "squares": F.round("squares", 4)})


@query("league_ladder_fit")
def league_ladder_fit(spark, sf):
    return league.ladder(moves(spark, sf), LEAGUES)


@query("league_ladder_bootstrap")
def league_ladder_bootstrap(spark, sf):
    return league.ladder_bootstrap(moves(spark, sf), LEAGUES)


@query("league_ladder_differences")
def league_ladder_differences(spark, sf):
    return league.ladder_differences(moves(spark, sf), LEAGUES)


@query("regression_curve", f"""WITH {_MOVES} SELECT cast(ceil(pct_complete / 20) - 1 as bigint) AS band, round(avg(pct_complete), 6) AS "before", round(avg(pct_complete_next), 6) AS "after", count(*) AS n FROM mv GROUP BY band""")
def regression_curve(spark, sf):
    out = league.regression_curve(moves(spark, sf), [0, 20, 40, 60, 80, 100])
    return _round(out, ["band", "n"], ["before", "after"])


@query("repeated_eleven", f"""WITH {FULL}, r AS (SELECT league, season, team_id, games_starts, row_number() OVER (PARTITION BY league, season, team_id ORDER BY games_starts DESC, player_key) AS rn FROM fr)
SELECT league, season, team_id, sum(case when rn <= 11 then games_starts end) AS eleven_starts, sum(games_starts) AS starts,
round(sum(case when rn <= 11 then games_starts end) / nullif(sum(games_starts), 0), 6) AS share FROM r GROUP BY league, season, team_id""")
def repeated_eleven(spark, sf):
    return league.repeated_eleven(full_rows(spark, sf)).withColumn("share", r6("share"))


@query("squad_explorer", f"""WITH {RANKED} SELECT fr.league, fr.season, fr.team_id, fr.player_key, fr.main_position, fr.minutes, fr.goals, fr.assists,
round(fr.minutes / nullif(sum(fr.minutes) OVER (PARTITION BY fr.league, fr.season, fr.team_id), 0), 6) AS minutes_share, round(pct_complete, 6) AS pct_complete
FROM fr LEFT JOIN rj ON rj.player_key = fr.player_key AND rj.league = fr.league AND rj.season = fr.season""")
def squad_explorer(spark, sf):
    return _round(league.explorer_rows(full_rows(spark, sf), ranked(spark, sf)),
                  ["league", "season", "team_id", "player_key", "main_position", "minutes", "goals", "assists"],
                  ["minutes_share", "pct_complete"])


@query("minutes_gini", f"""WITH {FULL}, r AS (SELECT league, season, team_id, minutes AS v, count(*) OVER (PARTITION BY league, season, team_id) AS n,
row_number() OVER (PARTITION BY league, season, team_id ORDER BY minutes) AS k FROM fr)
SELECT league, season, team_id, max(n) AS members, round(case when sum(v) > 0 then sum((2 * k - n - 1) * v) / (max(n) * sum(v)) end, 6) AS gini FROM r GROUP BY league, season, team_id""")
def minutes_gini(spark, sf):
    return gini(full_rows(spark, sf), ["league", "season", "team_id"], "minutes").withColumn("gini", r6("gini"))
