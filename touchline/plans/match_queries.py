"""Queries over matches: tables, profiles, probabilities and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import r6, ratio
from touchline.operators import competition, evaluate, inference, profiles, ranking, scoreline
from touchline.plans.registry import query
from touchline.plans.sql_text import uniform_from
from touchline.plans.views import ctes, table, view

V = ctes("v_match")
RHO = -0.05
WINDOW, MIN_PREV, GAP = 10, 3, 300

MM = f"""{V},
mm AS (SELECT * REPLACE (case when played then hg end AS hg, case when played then ag end AS ag) FROM v_match)"""
LNG = f"""{MM},
lng AS (
  SELECT match_id, match_date, league, season, played, phase, home AS team, away AS rival, 'H' AS side, hg AS gf, ag AS ga,
    hc AS cor, hy + hr AS car, hst AS sf, ast AS sa FROM mm
  UNION ALL
  SELECT match_id, match_date, league, season, played, phase, away, home, 'A', ag, hg, ac, ay + ar, ast, hst FROM mm)"""
METRIC_SQL = {"goals_for": "gf", "goals_against": "ga", "corners": "cor", "cards": "car", "on_target_for": "sf",
              "on_target_against": "sa"}


def matches(spark, sf) -> DataFrame:
    """Matches with scores only where played."""
    return competition.blank_unplayed(view(spark, sf, "v_match"))


def _rounded(df: DataFrame, keep: list[str], numbers: list[str]) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(c) for c in numbers])


def _sql_list(names, prefix=""):
    return ", ".join(f"round({prefix}{n}, 6) AS {n}" for n in names)


# --- tables and formats ---------------------------------------------------------------------------------------------

@query("standings", f"""WITH {LNG},
pts AS (SELECT league, season, team, count(*) AS played, sum(case when gf > ga then 3 when gf = ga then 1 else 0 end) AS points,
  sum(gf) AS goals_for, sum(ga) AS goals_against FROM lng WHERE played GROUP BY ALL)
SELECT league, season, team, played, cast(points as bigint) AS points, cast(goals_for as bigint) AS goals_for,
  cast(goals_against as bigint) AS goals_against, cast(goals_for - goals_against as bigint) AS difference,
  row_number() OVER (PARTITION BY league, season ORDER BY points DESC, goals_for - goals_against DESC, goals_for DESC, team) AS place
FROM pts""")
def standings(spark, sf):
    return competition.standings(matches(spark, sf), ["league", "season"])


_FORMAT = f"""WITH {MM},
side AS (SELECT league, season, home AS team, 1 AS h FROM mm UNION ALL SELECT league, season, away, 0 FROM mm),
per AS (SELECT league, season, team, count(*) AS n, sum(h) AS hn FROM side GROUP BY ALL),
bt AS (SELECT league, season, count(*) AS teams, sum((n <> 18)::int) AS off_n, sum((abs(hn - 9) > 0)::int) AS off_b FROM per GROUP BY ALL),
pr AS (SELECT league, season, sum((n > 1)::int) AS rep FROM (SELECT league, season, least(home, away) a, greatest(home, away) b, count(*) n
  FROM mm GROUP BY ALL) GROUP BY ALL),
rw AS (SELECT league, season, count(*) AS matches, count(*) - count(DISTINCT match_id) AS dup, sum((home = away)::int) AS self,
  sum((played AND (hg IS NULL OR ag IS NULL))::int) AS pws, sum((NOT played AND (hg IS NOT NULL OR ag IS NOT NULL))::int) AS uws
  FROM {{src}} GROUP BY ALL)
SELECT league, season, matches, teams, cast(off_n as bigint) AS teams_off_count, cast(off_b as bigint) AS teams_off_balance,
  cast(rep as bigint) AS repeated_pairings, cast(dup as bigint) AS repeated_ids, cast(self as bigint) AS against_itself,
  cast(pws as bigint) AS played_without_score, cast(uws as bigint) AS unplayed_with_score,
  concat_ws(',', case when off_n > 0 then 'teams_off_count' end, case when off_b > 0 then 'teams_off_balance' end,
    case when rep > 0 then 'repeated_pairings' end, case when dup > 0 then 'repeated_ids' end, case when self > 0 then 'against_itself' end,
    case when pws > 0 then 'played_without_score' end, case when uws > 0 then 'unplayed_with_score' end) AS failed_rules,
  matches = 90 AND teams = 10 AND off_n = 0 AND off_b = 0 AND rep = 0 AND dup = 0 AND self = 0 AND pws = 0 AND uws = 0 AS format_ok
FROM rw JOIN bt USING (league, season) JOIN pr USING (league, season)"""


def _format(df):
    return competition.format_check(df, ["league", "season"], 10, 18)


@query("format_control", _FORMAT.format(src="mm"))
def format_control(spark, sf):
    return _format(matches(spark, sf))


@query("format_control_filler_scores", _FORMAT.format(src="v_match"))
def format_control_filler_scores(spark, sf):
    return _format(view(spark, sf, "v_match"))


@query("season_balance", f"""WITH {V},
side AS (SELECT league, season, home AS team FROM v_match UNION ALL SELECT league, season, away FROM v_match),
per AS (SELECT league, season, team, count(*) AS n FROM side GROUP BY ALL),
sz AS (SELECT *, count(*) OVER (PARTITION BY league, season) AS teams FROM per),
ven AS (SELECT league, season, sum((n > 1)::int) AS rep FROM (SELECT league, season, home, away, count(*) n FROM v_match GROUP BY ALL) GROUP BY ALL)
SELECT league, season, max(teams) AS teams, cast(sum((n <> 2 * (teams - 1))::int) as bigint) AS teams_off,
  cast(max(rep) as bigint) AS repeated_fixtures FROM sz JOIN ven USING (league, season) GROUP BY league, season""")
def season_balance(spark, sf):
    return competition.season_balance(view(spark, sf, "v_match"), ["league", "season"])


@query("competition_overview", f"""WITH {V}
SELECT league, cast(sum(played::int) as bigint) AS results, cast(sum((NOT played)::int) as bigint) AS upcoming, cast(0 as bigint) AS undated,
  cast(max(case when played then match_date end) as string) AS last_result,
  cast(min(case when not played then match_date end) as string) AS first_upcoming FROM v_match GROUP BY league""")
def competition_overview(spark, sf):
    return competition.overview(view(spark, sf, "v_match"), ["league"])


@query("snapshot_newly_played", f"""WITH {V}
SELECT match_id, home, away, hg, ag FROM v_match WHERE played AND match_date > date '2000-06-30'""")
def snapshot_newly_played(spark, sf):
    now = view(spark, sf, "v_match")
    earlier = now.withColumn("played", F.col("played") & (F.col("match_date") <= F.lit("2000-06-30").cast("date")))
    return competition.newly_played(now, earlier).select("match_id", "home", "away", "hg", "ag")


@query("neutrality_violations", f"""WITH {V} SELECT match_id, referee, referee_country, home_country, away_country FROM v_match
WHERE referee_country = home_country OR referee_country = away_country""")
def neutrality_violations(spark, sf):
    return competition.neutrality_violations(view(spark, sf, "v_match")).select(
        "match_id", "referee", "referee_country", "home_country", "away_country")


# --- profiles -------------------------------------------------------------------------------------------------------

def _profile_sql(frame: str, order: str, min_prev: int, seg: str = "") -> str:
    cols = ",\n  ".join(
        f"case when count({c}) OVER w >= {min_prev} then avg({c}) OVER w end AS {m}" for m, c in METRIC_SQL.items())
    return f"""SELECT match_id, side, {cols} FROM {{src}}
  WINDOW w AS (PARTITION BY league, team, side{seg} ORDER BY {order} {frame})"""


def _pivot_sql(src: str) -> str:
    cols = ", ".join(f"round(max(case when side = '{s}' then {m} end), 6) AS {label}_{m}"
                     for s, label in (("H", "home"), ("A", "away")) for m in METRIC_SQL)
    return f"SELECT match_id, {cols} FROM {src} GROUP BY match_id"


PROFILE_COLUMNS = [f"{label}_{m}" for label in ("home", "away") for m in profiles.METRICS]
_ROLL = _profile_sql(f"ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING", "match_date, match_id", MIN_PREV)


@query("profile_rolling", f"WITH {LNG}, prof AS ({_ROLL.format(src='lng')}) {_pivot_sql('prof')}")
def profile_rolling(spark, sf):
    return _rounded(profiles.match_profiles(matches(spark, sf), WINDOW, MIN_PREV), ["match_id"], PROFILE_COLUMNS)


_EXP = _profile_sql("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "match_date, match_id", MIN_PREV, ", seg")
_GAP = f"""{LNG},
gp AS (SELECT *, match_date - lag(match_date) OVER (PARTITION BY league, team, side ORDER BY match_date, match_id) AS gap FROM lng),
sg AS (SELECT *, sum(case when gap > {GAP} then 1 else 0 end) OVER (PARTITION BY league, team, side ORDER BY match_date, match_id) AS seg FROM gp)"""


@query("profile_expanding_gap", f"WITH {_GAP}, prof AS ({_EXP.format(src='sg')}) {_pivot_sql('prof')}")
def profile_expanding_gap(spark, sf):
    return _rounded(profiles.match_profiles(matches(spark, sf), None, MIN_PREV, GAP), ["match_id"], PROFILE_COLUMNS)


_ASOF = ", ".join(f"sum({c}) OVER w / nullif(count(*) OVER w, 0) AS {m}" for m, c in METRIC_SQL.items())


@query("profile_asof_date", f"""WITH {LNG},
day_n AS (SELECT *, count(*) OVER (PARTITION BY league ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS history
  FROM mm),
prof AS (SELECT match_id, side, count(*) OVER w AS n, {_ASOF} FROM lng
  WINDOW w AS (PARTITION BY league, team, side ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
piv AS (SELECT match_id, {', '.join(f"round(max(case when side = '{s}' then {m} end), 6) AS {lb}_{m}" for s, lb in (("H", "home"), ("A", "away")) for m in METRIC_SQL)},
  min(n) AS least_n FROM prof GROUP BY match_id)
SELECT p.* EXCLUDE (least_n) FROM piv p JOIN day_n d USING (match_id) WHERE d.history >= 100 AND least_n > 0""")
def profile_asof_date(spark, sf):
    return _rounded(profiles.profiles_as_of(matches(spark, sf), 100), ["match_id"], PROFILE_COLUMNS)


@query("referee_strictness_asof", f"""WITH {MM},
x AS (SELECT match_id, referee, count(*) OVER l AS history, count(*) OVER r AS n, sum(hy + hr + ay + ar) OVER r AS s FROM mm
  WINDOW l AS (PARTITION BY league ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING),
  r AS (PARTITION BY league, referee ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT match_id, referee, case when n > 0 then n end AS earlier_matches, round(s / nullif(n, 0), 6) AS strictness FROM x WHERE history >= 100""")
def referee_strictness_asof(spark, sf):
    out = profiles.referee_strictness_as_of(matches(spark, sf), 100)
    return out.select("match_id", "referee", "earlier_matches", r6("strictness").alias("strictness"))


@query("profile_prior_seasons", f"""WITH {LNG},
tot AS (SELECT league, team, side, season, count(*) AS n, {', '.join(f'sum({c}) AS {m}' for m, c in METRIC_SQL.items())} FROM lng GROUP BY ALL),
lagd AS (SELECT league, team, side, season, sum(n) OVER w AS n, {', '.join(f'sum({m}) OVER w AS {m}' for m in METRIC_SQL)} FROM tot
  WINDOW w AS (PARTITION BY league, team, side ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, cast(h.n as bigint) AS home_matches, cast(a.n as bigint) AS away_matches,
  {', '.join(f'round({t}.{m} / {t}.n, 6) AS {lb}_{m}' for t, lb in (("h", "home"), ("a", "away")) for m in METRIC_SQL)}
FROM mm LEFT JOIN lagd h ON h.league = mm.league AND h.team = mm.home AND h.side = 'H' AND h.season = mm.season
LEFT JOIN lagd a ON a.league = mm.league AND a.team = mm.away AND a.side = 'A' AND a.season = mm.season""")
def profile_prior_seasons(spark, sf):
    return _rounded(profiles.profiles_prior_seasons(matches(spark, sf)),
                    ["match_id", "home_matches", "away_matches"], PROFILE_COLUMNS)


@query("matchday_number", f"""WITH {LNG},
n AS (SELECT match_id, row_number() OVER (PARTITION BY league, season, team ORDER BY match_date, match_id) AS nth FROM lng)
SELECT match_id, max(nth) AS matchday FROM n GROUP BY match_id""")
def matchday_number(spark, sf):
    return profiles.matchday_numbers(view(spark, sf, "v_match")).select("match_id", "matchday")


@query("head_to_head", f"""WITH {MM},
j AS (SELECT a.match_id, a.home, a.away, b.match_id AS other,
  case when b.home = a.home then b.hg - b.ag else b.ag - b.hg end AS d
  FROM mm a LEFT JOIN mm b ON a.league = b.league AND b.played AND b.match_date < a.match_date
    AND least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away)),
s AS (SELECT match_id, home, away, count(other) AS meetings, avg(d) AS mean_diff, coalesce(sum((d > 0)::int), 0) AS w,
  coalesce(sum((d = 0)::int), 0) AS dr, coalesce(sum((d < 0)::int), 0) AS l FROM j GROUP BY ALL)
SELECT match_id, home, away, meetings, round(mean_diff, 6) AS mean_diff,
  case when mean_diff > 0.15 then home when mean_diff < -0.15 then away when mean_diff is not null then 'even' end AS favourite,
  cast(w as bigint) AS home_wins, cast(dr as bigint) AS draws, cast(l as bigint) AS away_wins FROM s""")
def head_to_head(spark, sf):
    # unplayed fixtures are looked up too, but add no meeting of their own
    out = profiles.head_to_head(matches(spark, sf))
    return out.withColumn("mean_diff", r6("mean_diff"))


@query("window_study", f"""WITH {LNG},
tot AS (SELECT league, team, side, season, count(*) AS n, sum(gf) AS goals FROM lng GROUP BY ALL),
past AS (SELECT c.league, c.team, c.side, c.season, k.k AS seasons, sum(p.goals) / sum(p.n) AS predicted
  FROM tot c JOIN tot p ON p.league = c.league AND p.team = c.team AND p.side = c.side AND p.season < c.season
  JOIN (SELECT unnest([1, 2, 3, 0]) AS k) k ON k.k = 0 OR p.season >= c.season - k.k GROUP BY ALL),
j AS (SELECT p.seasons, t.goals / t.n AS actual, p.predicted, t.n FROM past p JOIN tot t USING (league, team, side, season))
SELECT seasons, count(*) AS team_seasons, round(avg(abs(actual - predicted)), 6) AS mae,
  round(sum(abs(actual - predicted) * n) / sum(n), 6) AS weighted_mae,
  round(covar_pop(actual, predicted) / nullif(stddev_pop(actual) * stddev_pop(predicted), 0), 6) AS r FROM j
WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY seasons""")
def window_study(spark, sf):
    from touchline.functions.numeric import pearson, weighted_mean

    rows = profiles.window_study(matches(spark, sf), [1, 2, 3, 0]).filter(
        F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    gap = F.abs(F.col("actual") - F.col("predicted"))
    return rows.groupBy("seasons").agg(
        F.count(F.lit(1)).alias("team_seasons"), r6(F.avg(gap)).alias("mae"),
        r6(weighted_mean(gap, F.col("n"))).alias("weighted_mae"), r6(pearson("actual", "predicted")).alias("r"))


# --- probabilities --------------------------------------------------------------------------------------------------

FORECAST = f"""{LNG}, prof AS ({_ROLL.format(src='lng')}),
ex AS (SELECT m.*, greatest((h.goals_for + a.goals_against) / 2, 0.05) AS lam, greatest((a.goals_for + h.goals_against) / 2, 0.05) AS mu
  FROM mm m JOIN prof h ON h.match_id = m.match_id AND h.side = 'H' JOIN prof a ON a.match_id = m.match_id AND a.side = 'A'
  WHERE h.goals_for + a.goals_against IS NOT NULL AND a.goals_for + h.goals_against IS NOT NULL),
cells AS (SELECT match_id, i, j, greatest(exp(-lam + i * ln(lam) - lgamma(i + 1)) * exp(-mu + j * ln(mu) - lgamma(j + 1))
    * case when i = 0 and j = 0 then 1 - lam * mu * ({RHO}) when i = 0 and j = 1 then 1 + lam * ({RHO})
      when i = 1 and j = 0 then 1 + mu * ({RHO}) when i = 1 and j = 1 then 1 - ({RHO}) else 1 end, 1e-12) AS p
  FROM ex, (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS j)),
pr AS (SELECT match_id, sum(case when i = j then p else 0 end) / sum(p) AS p_draw, sum(case when i > j then p else 0 end) / sum(p) AS p_home,
  sum(case when i < j then p else 0 end) / sum(p) AS p_away FROM cells GROUP BY match_id),
fc AS (SELECT ex.*, p_draw, p_home, p_away, (1 / odds_d) / (1 / odds_h + 1 / odds_d + 1 / odds_a) AS m_draw,
  (1 / odds_h) / (1 / odds_h + 1 / odds_d + 1 / odds_a) AS m_home, (1 / odds_a) / (1 / odds_h + 1 / odds_d + 1 / odds_a) AS m_away,
  case when hg > ag then 'H' when hg < ag then 'A' when hg = ag then 'D' end AS actual FROM ex JOIN pr USING (match_id)),
ev AS (SELECT *, greatest(p_draw, p_home, p_away) - least(p_draw, p_home, p_away) <= 0.125 AS p_even FROM fc
  WHERE actual IS NOT NULL AND m_home IS NOT NULL)"""


def score_sql(prefix: str) -> dict[str, str]:
    d, h, a = (f"{prefix}_{k}" for k in ("draw", "home", "away"))
    return {
        "logloss": f"-ln(greatest(case actual when 'D' then {d} when 'H' then {h} else {a} end, 1e-12))",
        "brier": f"(power({d} - (actual = 'D')::int, 2) + power({h} - (actual = 'H')::int, 2) + power({a} - (actual = 'A')::int, 2))",
        "rps": f"0.5 * (power({h} - (actual = 'H')::int, 2) + power({h} + {d} - (actual <> 'A')::int, 2))",
        "hit": f"(case when round({d}, 9) >= round({h}, 9) and round({d}, 9) >= round({a}, 9) then 'D'"
               f" when round({h}, 9) >= round({a}, 9) then 'H' else 'A' end = actual)::int",
    }


def forecasts(spark, sf) -> DataFrame:
    """Profiles, expected goals, model and market probabilities and the outcome, one row per match."""
    prof = profiles.match_profiles(matches(spark, sf), WINDOW, MIN_PREV, metrics={
        k: profiles.METRICS[k] for k in ("goals_for", "goals_against")})
    exp = scoreline.naive_expectations(prof)
    probs = scoreline.outcome_probabilities(exp.filter("lam IS NOT NULL AND mu IS NOT NULL"), "lam", "mu", RHO)
    return scoreline.market_probabilities(probs, "odds_h", "odds_d", "odds_a").withColumn("actual", evaluate.outcome())


def evaluated(spark, sf) -> DataFrame:
    """Played matches with model and market probabilities: the common support of both."""
    return evaluate.on_common_support(forecasts(spark, sf), ["hg", "lam", "mu", "odds_h"])


@query("score_matrix_1x2", f"""WITH {FORECAST} SELECT match_id, {_sql_list(['lam', 'mu', 'p_home', 'p_draw', 'p_away'])} FROM fc""")
def score_matrix_1x2(spark, sf):
    return _rounded(forecasts(spark, sf), ["match_id"], ["lam", "mu", "p_home", "p_draw", "p_away"])


@query("market_probs", f"""WITH {V}, q AS (SELECT match_id, 1 / odds_h + 1 / odds_d + 1 / odds_a AS inv, odds_h, odds_d, odds_a FROM v_match)
SELECT match_id, round(1 / odds_h / inv, 6) AS m_home, case when inv is not null then round(1 / odds_d / inv, 6) end AS m_draw,
  round(1 / odds_a / inv, 6) AS m_away FROM q""")
def market_probs(spark, sf):
    out = scoreline.market_probabilities(view(spark, sf, "v_match"), "odds_h", "odds_d", "odds_a")
    return _rounded(out, ["match_id"], ["m_home", "m_draw", "m_away"])


def _halving(name: str, low: float, high: float, p: str) -> str:
    """Fifty halvings for the value at which the three probabilities add up to 1; `p` is the probability of {i} at m."""
    total = " + ".join(p.format(i=i, m="m") for i in "hda")
    return (f"{name} AS (SELECT *, 0 AS k, {low}::double AS lo, {high}::double AS hi FROM x UNION ALL SELECT match_id, league, h, d, a, b, k + 1, "
            f"case when s < 1 then lo else m end, case when s < 1 then m else hi end FROM (SELECT *, {total} AS s FROM "
            f"(SELECT *, (lo + hi) / 2 AS m FROM {name} WHERE k < 50)))")


_SHIN = "(sqrt({m} * {m} + 4 * (1 - {m}) * {i} * {i} / b) - {m}) / (2 * (1 - {m}))"
_ODDS_RATIO = "{i} / ({m} + {i} - {m} * {i})"
_SHIFTS = ", ".join(f"round(avg(abs({p.format(i=f'z.{i}', m=f'(({t}.lo + {t}.hi) / 2)').replace(' b)', ' z.b)')} - z.{i} / z.b)), 6) AS {n}_{k}_shift"
                    for n, t, p in (("shin", "z", _SHIN), ("oratio", "c", _ODDS_RATIO)) for i, k in (("h", "home"), ("d", "draw"), ("a", "away")))


@query("market_margin_methods", f"""WITH RECURSIVE {V}, x AS (SELECT match_id, league, 1 / odds_h AS h, 1 / odds_d AS d, 1 / odds_a AS a, 1 / odds_h + 1 / odds_d + 1 / odds_a AS b
  FROM v_match WHERE odds_h IS NOT NULL), {_halving('zs', 0.0, 0.4, _SHIN)}, {_halving('cs', 0.2, 5.0, _ODDS_RATIO)}
SELECT z.league, count(*) AS n, {_SHIFTS} FROM zs z JOIN cs c USING (match_id) WHERE z.k = 50 AND c.k = 50 GROUP BY z.league""")
def market_margin_methods(spark, sf):
    """Proportional, Shin and odds-ratio margins side by side, as mean absolute shifts by league."""
    df = view(spark, sf, "v_match").filter("odds_h IS NOT NULL")
    df = scoreline.market_probabilities(df, "odds_h", "odds_d", "odds_a")
    df = scoreline.odds_ratio_probabilities(
        scoreline.shin_probabilities(df, "odds_h", "odds_d", "odds_a"), "odds_h", "odds_d", "odds_a")
    return df.groupBy("league").agg(
        F.count(F.lit(1)).alias("n"),
        *[r6(F.avg(F.abs(F.col(f"{m}_{k}") - F.col(f"m_{k}")))).alias(f"{m}_{k}_shift")
          for m in ("shin", "oratio") for k in ("home", "draw", "away")])


_S, _M = score_sql("p"), score_sql("m")
FLAGSHIP = f"""WITH {FORECAST}
SELECT season, count(*) AS n, round(avg({_S['rps']}), 6) AS rps_model, round(avg({_M['rps']}), 6) AS rps_market,
  round(avg({_S['rps']}) - avg({_M['rps']}), 6) AS rps_difference, round(avg({_S['logloss']}), 6) AS logloss_model,
  round(avg({_M['logloss']}), 6) AS logloss_market, round(avg({_S['brier']}), 6) AS brier_model, round(avg({_M['brier']}), 6) AS brier_market,
  round(avg({_S['hit']}), 6) AS hit_model, round(avg({_M['hit']}), 6) AS hit_market FROM ev GROUP BY season"""


@query("forecast_rps_by_season", FLAGSHIP)
def forecast_rps_by_season(spark, sf):
    """Flagship: leakage-free profiles to probabilities, scored against the market season by season."""
    s = evaluate.with_scores(evaluate.with_scores(evaluated(spark, sf), "p", suffix="_model"), "m", suffix="_market")
    means = {f"{k}_{w}": F.avg(f"{k}_{w}") for k in ("rps", "logloss", "brier", "hit") for w in ("model", "market")}
    out = s.groupBy("season").agg(F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in means.items()],
                                  (F.avg("rps_model") - F.avg("rps_market")).alias("rps_difference"))
    return _rounded(out, ["season", "n"], [*means, "rps_difference"])


_ALL = "UNBOUNDED"
#: Windows of the grid (0: all earlier matches), and how much of each side's expected goals comes from its shots on target.
GRID_WINDOWS, GRID_SETS, GOALS_PER_SHOT = [0, 20, 10, 5], {"goals": 0.0, "goals_and_shots": 0.5}, 0.3


def _grid_mean(own: str, other: str, weight: float) -> str:
    goals = f"({own}_goals_for + {other}_goals_against) / 2"
    shots = f"{GOALS_PER_SHOT} * ({own}_on_target_for + {other}_on_target_against) / 2"
    return f"greatest({1 - weight} * {goals} + {weight} * {shots}, 0.05)"


_GRID_PROFILES = " UNION ALL ".join(
    f"SELECT {n} AS \"window\", * FROM ({_profile_sql(f'ROWS BETWEEN {n or _ALL} PRECEDING AND 1 PRECEDING', 'match_date, match_id', MIN_PREV).format(src='lng')})"
    for n in GRID_WINDOWS)
_GRID = f"""{LNG}, gp AS ({_GRID_PROFILES}),
gm AS (SELECT match_id, "window", {', '.join(f"max(case when side = '{s}' then {m} end) AS {lb}_{m}" for s, lb in (("H", "home"), ("A", "away")) for m in METRIC_SQL)} FROM gp GROUP BY ALL),
gx AS ({' UNION ALL '.join(f"SELECT match_id, \"window\", '{name}' AS features, {_grid_mean('home', 'away', w)} AS lam, {_grid_mean('away', 'home', w)} AS mu FROM gm WHERE home_goals_for + away_goals_against + away_goals_for + home_goals_against + home_on_target_for IS NOT NULL" for name, w in GRID_SETS.items())}),
gc AS (SELECT match_id, "window", features, i, j, greatest(exp(-lam + i * ln(lam) - lgamma(i + 1)) * exp(-mu + j * ln(mu) - lgamma(j + 1))
    * case when i = 0 and j = 0 then 1 - lam * mu * ({RHO}) when i = 0 and j = 1 then 1 + lam * ({RHO}) when i = 1 and j = 0 then 1 + mu * ({RHO}) when i = 1 and j = 1 then 1 - ({RHO}) else 1 end, 1e-12) AS p
  FROM gx, (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS j)),
gr AS (SELECT match_id, "window", features, sum(case when i = j then p else 0 end) / sum(p) AS p_draw, sum(case when i > j then p else 0 end) / sum(p) AS p_home, sum(case when i < j then p else 0 end) / sum(p) AS p_away FROM gc GROUP BY ALL),
ga AS (SELECT gr.*, case when hg > ag then 'H' when hg < ag then 'A' else 'D' end AS actual FROM gr JOIN mm USING (match_id) WHERE hg IS NOT NULL)"""


@query("feature_window_grid", f"""WITH {_GRID} SELECT "window", features, count(*) AS n, round(avg({_S['rps']}), 6) AS rps, round(avg({_S['logloss']}), 6) AS logloss FROM ga GROUP BY ALL""")
def feature_window_grid(spark, sf):
    """Every window length with every set of features: RPS and log-loss of its forecasts, profiles from one pass."""
    m = matches(spark, sf)
    grid = profiles.profile_grid(m, GRID_WINDOWS, MIN_PREV)
    grid = grid.filter("home_goals_for + away_goals_against + away_goals_for + home_goals_against + home_on_target_for IS NOT NULL")
    sets = F.array(*[F.struct(F.lit(name).alias("features"), F.expr(_grid_mean("home", "away", w)).alias("lam"),
                              F.expr(_grid_mean("away", "home", w)).alias("mu")) for name, w in GRID_SETS.items()])
    means = grid.select("match_id", "window", F.inline(sets)).join(
        m.filter("hg IS NOT NULL").select("match_id", "hg", "ag"), "match_id")
    p = scoreline.outcome_probabilities(means, "lam", "mu", F.lit(RHO)).withColumn("actual", evaluate.outcome())
    return evaluate.with_scores(p, "p").groupBy("window", "features").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("rps")).alias("rps"), r6(F.avg("logloss")).alias("logloss"))


_STACK = f"""{FORECAST}, st AS (SELECT match_id, league, season, actual, 'market' AS model, m_draw AS q_draw, m_home AS q_home, m_away AS q_away FROM ev
UNION ALL SELECT match_id, league, season, actual, 'model', p_draw, p_home, p_away FROM ev),
sr AS (SELECT *, greatest(q_draw, q_home, q_away) - least(q_draw, q_home, q_away) <= 0.125 AS ev_, (actual = 'D')::int AS dr,
  rank() OVER (PARTITION BY model ORDER BY round(q_draw, 9)) + (count(*) OVER (PARTITION BY model, round(q_draw, 9)) - 1) / 2.0 AS rk FROM st)"""
_Q = score_sql("q")


@query("metric_table", f"""WITH {_STACK}
SELECT model, count(*) AS n, round(avg({_Q['hit']}), 6) AS hit_rate, round(avg({_Q['logloss']}), 6) AS logloss, round(avg({_Q['brier']}), 6) AS brier,
  round(avg({_Q['rps']}), 6) AS rps, round(avg(q_draw), 6) AS mean_p_draw, round(avg(dr), 6) AS draw_rate,
  cast(sum((round(q_draw, 9) >= round(q_home, 9) AND round(q_draw, 9) >= round(q_away, 9))::int) as bigint) AS draw_picks, cast(sum(ev_::int) as bigint) AS even_matches,
  round(avg(case when ev_ then dr end), 6) AS draws_even, round(avg(case when not ev_ then dr end), 6) AS draws_rest,
  round((sum(rk * dr) - sum(dr) * (sum(dr) + 1) / 2.0) / (sum(dr) * (count(*) - sum(dr))), 6) AS auc_draw FROM sr GROUP BY model""")
def metric_table(spark, sf):
    st = evaluate.stack_models(evaluated(spark, sf), ["match_id", "league", "season", "actual"],
                               {"model": "p", "market": "m"})
    out = evaluate.metric_table(st, ["model"])
    return _rounded(out, ["model", "n", "draw_picks", "even_matches"],
                    ["hit_rate", "logloss", "brier", "rps", "mean_p_draw", "draw_rate", "draws_even", "draws_rest",
                     "auc_draw"])


@query("baseline_frequencies", f"""WITH {MM}, y AS (SELECT league, season, sum((hg = ag)::int) AS d, sum((hg > ag)::int) AS h, sum((hg < ag)::int) AS a
  FROM mm WHERE played GROUP BY ALL),
c AS (SELECT league, season, sum(d) OVER w AS d, sum(h) OVER w AS h, sum(a) OVER w AS a FROM y
  WINDOW w AS (PARTITION BY league ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT league, season, cast(d + h + a as bigint) AS training, round(d / (d + h + a), 6) AS b_draw, round(h / (d + h + a), 6) AS b_home,
  round(a / (d + h + a), 6) AS b_away FROM c""")
def baseline_frequencies(spark, sf):
    m = matches(spark, sf).filter("played").withColumn("actual", evaluate.outcome())
    return _rounded(evaluate.baseline_frequencies(m, ["league"], "season", "actual"),
                    ["league", "season", "training"], ["b_draw", "b_home", "b_away"])


@query("calibration_curve", f"""WITH {_STACK}
SELECT model, cast(floor((q_draw - 0.10) / 0.05) as bigint) AS bin, count(*) AS n, round(avg(q_draw), 6) AS mean_forecast,
  round(avg(dr), 6) AS observed FROM sr WHERE floor((q_draw - 0.10) / 0.05) BETWEEN 0 AND 5 GROUP BY ALL HAVING count(*) >= 50""")
def calibration_curve(spark, sf):
    st = evaluate.stack_models(evaluated(spark, sf), ["actual"], {"model": "p", "market": "m"}).withColumn(
        "draw", F.col("actual") == "D")
    out = evaluate.calibration_bins(st, ["model"], "q_draw", "draw", 0.10, 0.05, 6)
    return _rounded(out, ["model", "bin", "n"], ["mean_forecast", "observed"])


_BINS = f"""{_STACK}, b AS (SELECT model, least(floor(q_draw / 0.1), 9) AS bin, count(*) AS n, avg(q_draw) AS f, avg(dr) AS o FROM sr GROUP BY ALL)"""


@query("ece", f"WITH {_BINS} SELECT model, round(sum(n * abs(f - o)) / sum(n), 6) AS ece, cast(sum(n) as bigint) AS n FROM b GROUP BY model")
def ece(spark, sf):
    st = evaluate.stack_models(evaluated(spark, sf), ["actual"], {"model": "p", "market": "m"}).withColumn(
        "draw", F.col("actual") == "D")
    return _rounded(evaluate.expected_calibration_error(st, ["model"], "q_draw", "draw"), ["model", "n"], ["ece"])


@query("murphy", f"""WITH {_BINS} SELECT model, cast(sum(n) as bigint) AS n, round(sum(n * power(f - o, 2)) / sum(n), 6) AS reliability,
  round(sum(n * o * o) / sum(n) - power(sum(n * o) / sum(n), 2), 6) AS resolution,
  round(sum(n * o) / sum(n) * (1 - sum(n * o) / sum(n)), 6) AS uncertainty FROM b GROUP BY model""")
def murphy(spark, sf):
    st = evaluate.stack_models(evaluated(spark, sf), ["actual"], {"model": "p", "market": "m"}).withColumn(
        "draw", F.col("actual") == "D")
    return _rounded(evaluate.brier_decomposition(st, ["model"], "q_draw", "draw"), ["model", "n"],
                    ["reliability", "resolution", "uncertainty"])


@query("temperature_scaling", f"""WITH {FORECAST}, t AS (SELECT actual, unnest([0.5, 0.8, 1.0, 1.25, 2.0]) AS t, p_draw, p_home, p_away FROM ev),
r AS (SELECT t, actual, power(greatest(p_draw, 1e-12), 1 / t) AS d, power(greatest(p_home, 1e-12), 1 / t) AS h, power(greatest(p_away, 1e-12), 1 / t) AS a FROM t)
SELECT cast(t as double) AS temperature, count(*) AS n, round(avg(-ln(greatest(case actual when 'D' then d when 'H' then h else a end / (d + h + a), 1e-12))), 6) AS logloss
FROM r GROUP BY t""")
def temperature_scaling(spark, sf):
    out = evaluate.temperature_grid(evaluated(spark, sf), "p", "actual", [0.5, 0.8, 1.0, 1.25, 2.0])
    return _rounded(out, ["temperature", "n"], ["logloss"])


# --- intervals and tests --------------------------------------------------------------------------------------------

_BLOCKS = f"""{FORECAST}, md AS (SELECT match_id, max(nth) AS matchday FROM (SELECT match_id, row_number() OVER (PARTITION BY league, season, team
  ORDER BY match_date, match_id) AS nth FROM lng) GROUP BY match_id)"""
BLOCK_REPLICATES = 2000


def _copies_sql(u: str) -> str:
    from touchline.functions.probability import COPIES_CDF

    return "case " + " ".join(f"when {u} < {c!r} then {k}" for k, c in enumerate(COPIES_CDF)) + f" else {len(COPIES_CDF)} end"


@query("even_match_block_ci", f"""WITH {_BLOCKS},
bl AS (SELECT league_no * 1000000 + (season % 100) * 10000 + matchday AS block, sum(p_even::int) AS n_even, sum((p_even AND actual = 'D')::int) AS d_even,
  sum((NOT p_even)::int) AS n_rest, sum((NOT p_even AND actual = 'D')::int) AS d_rest FROM ev JOIN md USING (match_id) GROUP BY ALL),
dr AS (SELECT replicate, n_even, d_even, n_rest, d_rest, {_copies_sql('u')} AS k FROM
  {uniform_from(f'bl, (SELECT unnest(range({BLOCK_REPLICATES})) AS replicate)', 'u', 7, 'block', 'replicate')}),
rp AS (SELECT replicate, 100 * (sum(d_even * k) / nullif(sum(n_even * k), 0) - sum(d_rest * k) / nullif(sum(n_rest * k), 0)) AS excess FROM dr GROUP BY replicate)
SELECT (SELECT count(*) FROM bl) AS units,
  round((SELECT 100 * (sum(d_even) / nullif(sum(n_even), 0) - sum(d_rest) / nullif(sum(n_rest), 0)) FROM bl), 6) AS excess_value,
  round(quantile_cont(excess, 0.025), 6) AS excess_low, round(quantile_cont(excess, 0.975), 6) AS excess_high FROM rp""")
def even_match_block_ci(spark, sf):
    ev = evaluated(spark, sf).withColumn("even", evaluate.is_even("p"))
    md = profiles.matchday_numbers(view(spark, sf, "v_match")).select("match_id", "matchday")
    even, draw = F.col("even"), F.col("actual") == "D"
    block = (F.col("league_no") * 1000000 + (F.col("season") % 100) * 10000 + F.col("matchday")).alias("block")
    bl = inference.blocks(ev.join(md, "match_id").withColumn("block", block), ["block"], {
        "n_even": F.sum(even.cast("int")), "d_even": F.sum((even & draw).cast("int")),
        "n_rest": F.sum((~even).cast("int")), "d_rest": F.sum((~even & draw).cast("int"))})
    excess = 100 * (ratio("d_even", "n_even") - ratio("d_rest", "n_rest"))
    out = inference.bootstrap(bl, "block", ["n_even", "d_even", "n_rest", "d_rest"], {"excess": excess},
                              BLOCK_REPLICATES, few_units=True)
    return _rounded(out, ["units"], ["excess_value", "excess_low", "excess_high"])


@query("paired_bootstrap", f"""WITH {_BLOCKS}, u AS (SELECT league_no * 1000000 + (season % 100) * 10000 + matchday AS block, sum({_S['logloss']} - {_M['logloss']}) AS d, count(*) AS n
  FROM ev JOIN md USING (match_id) GROUP BY ALL),
dr AS (SELECT replicate, d, n, {_copies_sql('u')} AS k FROM
  {uniform_from(f'u, (SELECT unnest(range({BLOCK_REPLICATES})) AS replicate)', 'u', 11, 'block', 'replicate')}),
rp AS (SELECT replicate, sum(d * k) / sum(n * k) AS m FROM dr GROUP BY replicate)
SELECT (SELECT count(*) FROM u) AS units, round((SELECT sum(d) / sum(n) FROM u), 6) AS mean_diff_value, round(quantile_cont(m, 0.025), 6) AS mean_diff_low,
  round(quantile_cont(m, 0.975), 6) AS mean_diff_high,
  case when quantile_cont(m, 0.975) < 0 then 'model better' when quantile_cont(m, 0.025) > 0 then 'market better' else 'no difference' end AS decision
FROM rp""")
def paired_bootstrap(spark, sf):
    s = evaluate.with_scores(evaluate.with_scores(evaluated(spark, sf), "p", suffix="_p"), "m", suffix="_m")
    md = profiles.matchday_numbers(view(spark, sf, "v_match")).select("match_id", "matchday")
    block = F.col("league_no") * 1000000 + (F.col("season") % 100) * 10000 + F.col("matchday")
    units = inference.blocks(s.join(md, "match_id").withColumn("block", block), ["block"], {
        "d": F.sum(F.col("logloss_p") - F.col("logloss_m")), "n": F.count(F.lit(1))})
    out = inference.bootstrap(units, "block", ["d", "n"], {"mean_diff": ratio("d", "n")}, BLOCK_REPLICATES, seed=11, few_units=True)
    out = out.withColumn("decision", evaluate.decision("mean_diff_low", "mean_diff_high"))
    return _rounded(out, ["units", "decision"], ["mean_diff_value", "mean_diff_low", "mean_diff_high"])


@query("league_block_ci", f"""WITH {_BLOCKS}, u AS (SELECT league_no, (season % 100) * 10000 + matchday AS block, sum({_S['logloss']} - {_M['logloss']}) AS d,
  sum({_S['rps']}) AS sp, sum({_M['rps']}) AS sm, count(*) AS n FROM ev JOIN md USING (match_id) GROUP BY ALL),
dr AS (SELECT league_no, replicate, d, sp, sm, n, {_copies_sql('u')} AS k FROM
  {uniform_from(f'u, (SELECT unnest(range({BLOCK_REPLICATES})) AS replicate)', 'u', 13, 'block', 'replicate')}),
rp AS (SELECT league_no, replicate, sum(d * k) / nullif(sum(n * k), 0) AS m, 1 - sum(sp * k) / nullif(sum(sm * k), 0) AS s FROM dr GROUP BY ALL),
w AS (SELECT league_no, count(*) AS units, sum(d) / sum(n) AS m, 1 - sum(sp) / sum(sm) AS s FROM u GROUP BY league_no)
SELECT league_no, units, round(w.m, 6) AS mean_diff_value, round(quantile_cont(rp.m, 0.025), 6) AS mean_diff_low, round(quantile_cont(rp.m, 0.975), 6) AS mean_diff_high,
  round(w.s, 6) AS skill_value, round(quantile_cont(rp.s, 0.025), 6) AS skill_low, round(quantile_cont(rp.s, 0.975), 6) AS skill_high
FROM rp JOIN w USING (league_no) GROUP BY ALL""")
def league_block_ci(spark, sf):
    """Per league: model minus market in log-loss and the model's skill score against the market, with block intervals."""
    s = evaluate.with_scores(evaluate.with_scores(evaluated(spark, sf), "p", suffix="_p"), "m", suffix="_m")
    md = profiles.matchday_numbers(view(spark, sf, "v_match")).select("match_id", "matchday")
    units = inference.blocks(s.join(md, "match_id").withColumn("block", (F.col("season") % 100) * 10000 + F.col("matchday")),
                             ["league_no", "block"], {"d": F.sum(F.col("logloss_p") - F.col("logloss_m")), "sp": F.sum("rps_p"),
                                                      "sm": F.sum("rps_m"), "n": F.count(F.lit(1))})
    out = inference.bootstrap(units, "block", ["d", "sp", "sm", "n"], {"mean_diff": ratio("d", "n"), "skill": evaluate.skill("sp", "sm")},
                              BLOCK_REPLICATES, seed=13, groups=["league_no"], few_units=True)
    return _rounded(out, ["league_no", "units"], [f"{x}_{end}" for x in ("mean_diff", "skill") for end in ("value", "low", "high")])


@query("next_fixtures", f"""WITH {V} SELECT league, match_id, cast(match_date as string) AS match_date, rank FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY match_date, match_id) AS rank
  FROM v_match WHERE match_date > date '1998-06-30') WHERE rank <= 6""")
def next_fixtures(spark, sf):
    from touchline.operators.ordered import next_rows

    out = next_rows(view(spark, sf, "v_match"), ["league"], "match_date", "match_id", F.lit("1998-06-30").cast("date"), 6)
    return out.select("league", "match_id", F.col("match_date").cast("string").alias("match_date"), "rank")


@query("latest_results", f"""WITH {V} SELECT league, match_id, cast(match_date as string) AS match_date, rank FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY match_date DESC, match_id DESC) AS rank
  FROM v_match WHERE match_date <= date '1998-06-30' AND played) WHERE rank <= 6""")
def latest_results(spark, sf):
    from touchline.operators.ordered import latest_rows

    out = latest_rows(view(spark, sf, "v_match").filter("played"), ["league"], "match_date", "match_id", F.lit("1998-06-30").cast("date"), 6)
    return out.select("league", "match_id", F.col("match_date").cast("string").alias("match_date"), "rank")


@query("widest_goal_differences", f"""WITH {V} SELECT league, match_id, hg - ag AS difference, rank FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY abs(hg - ag) DESC, match_id) AS rank
  FROM v_match WHERE played) WHERE rank <= 5""")
def widest_goal_differences(spark, sf):
    from touchline.operators.ordered import largest_magnitudes

    rows = view(spark, sf, "v_match").filter("played").withColumn("difference", F.col("hg") - F.col("ag"))
    return largest_magnitudes(rows, ["league"], "difference", "match_id", 5).select("league", "match_id", "difference", "rank")


@query("model_minus_market_by_league", f"""WITH {FORECAST}, d AS (SELECT league, p_even, {_S['rps']} - {_M['rps']} AS d FROM ev)
SELECT league, count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d) / sqrt(count(*)), 6) AS se,
  round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 6) AS z, round(avg(case when p_even then d end), 6) AS mean_even,
  cast(ceil(power((1.959964 + 0.841621) * stddev_samp(d) / 0.01, 2)) as bigint) AS needed_for_001 FROM d GROUP BY league""")
def model_minus_market_by_league(spark, sf):
    s = evaluate.with_scores(evaluate.with_scores(evaluated(spark, sf), "p", suffix="_p"), "m", suffix="_m")
    s = s.withColumn("even", evaluate.is_even("p"))
    out = inference.paired_difference(s, ["league"], "rps_p", "rps_m")
    even = s.groupBy("league").agg(F.avg(F.when(F.col("even"), F.col("rps_p") - F.col("rps_m"))).alias("mean_even"))
    out = out.join(even, "league").withColumn("needed_for_001", inference.required_pairs("sd", 0.01).cast("bigint"))
    return _rounded(out, ["league", "n", "needed_for_001"], ["mean_diff", "se", "z", "mean_even"])


@query("excluded_share", f"""WITH {LNG}, prof AS ({_ROLL.format(src='lng')}),
x AS (SELECT m.season, (h.goals_for IS NULL OR a.goals_for IS NULL)::int AS e FROM mm m JOIN prof h ON h.match_id = m.match_id AND h.side = 'H'
  JOIN prof a ON a.match_id = m.match_id AND a.side = 'A')
SELECT season, count(*) AS n, round(avg(e), 6) AS excluded FROM x GROUP BY season""")
def excluded_share(spark, sf):
    prof = profiles.match_profiles(matches(spark, sf), WINDOW, MIN_PREV, metrics={"goals_for": ("hg", "ag")})
    gone = (F.col("home_goals_for").isNull() | F.col("away_goals_for").isNull()).cast("double")
    return prof.groupBy("season").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(gone)).alias("excluded"))


@query("auc_draw", f"""WITH {V}, x AS (SELECT league, round(1 / odds_d / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS s, (hg = ag)::int AS y FROM v_match
  WHERE played AND odds_h IS NOT NULL),
r AS (SELECT league, y, rank() OVER (PARTITION BY league ORDER BY s) + (count(*) OVER (PARTITION BY league, s) - 1) / 2.0 AS rk FROM x)
SELECT league, cast(sum(y) as bigint) AS positives, cast(count(*) - sum(y) as bigint) AS negatives,
  round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM r GROUP BY league""")
def auc_draw(spark, sf):
    df = scoreline.market_probabilities(view(spark, sf, "v_match").filter("played AND odds_h IS NOT NULL"),
                                        "odds_h", "odds_d", "odds_a")
    df = df.withColumn("s", r6("m_draw")).withColumn("y", F.col("hg") == F.col("ag"))
    return ranking.auc(df, ["league"], "s", "y").withColumn("auc", r6("auc"))


@query("auc_labels", """WITH x AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)),
r AS (SELECT lang, quality AS y, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM x)
SELECT lang, cast(sum(y) as bigint) AS positives, cast(count(*) - sum(y) as bigint) AS negatives,
  round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM r GROUP BY lang""")
def auc_labels(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return ranking.auc(df, ["lang"], "n_chars", "quality").withColumn("auc", r6("auc"))


def _ln_choose_sql(n, k):
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


_LP = (f"{_ln_choose_sql('cl', '{k}')} + {_ln_choose_sql('(n - cl)', '(rw - {k})')} - {_ln_choose_sql('n', 'rw')}")


@query("fisher_even", f"""WITH {FORECAST}, t AS (SELECT season, cast(sum((p_even AND actual = 'D')::int) as bigint) AS a, cast(sum((p_even AND actual <> 'D')::int) as bigint) AS b,
  cast(sum((NOT p_even AND actual = 'D')::int) as bigint) AS c, cast(sum((NOT p_even AND actual <> 'D')::int) as bigint) AS d FROM ev GROUP BY season),
q AS (SELECT *, a + b AS rw, a + c AS cl, a + b + c + d AS n FROM t),
k AS (SELECT *, unnest(range(greatest(0, rw + cl - n), least(rw, cl) + 1)) AS k FROM q),
l AS (SELECT season, a, b, c, d, {_LP.format(k='k')} AS lk, {_LP.format(k='a')} AS la FROM k)
SELECT season, a AS draws_even, b AS others_even, c AS draws_rest, d AS others_rest,
  round(least(1, sum(case when lk <= la + 1e-7 then exp(lk) else 0 end)), 6) AS p_value,
  case when least(1, sum(case when lk <= la + 1e-7 then exp(lk) else 0 end)) < 0.05 then 'clear' else 'not clear' end AS signal
FROM l GROUP BY season, a, b, c, d""")
def fisher_even(spark, sf):
    ev = evaluated(spark, sf).withColumn("even", evaluate.is_even("p"))
    e, d = F.col("even"), F.col("actual") == "D"
    t = ev.groupBy("season").agg(
        F.sum((e & d).cast("int")).alias("draws_even"), F.sum((e & ~d).cast("int")).alias("others_even"),
        F.sum((~e & d).cast("int")).alias("draws_rest"), F.sum((~e & ~d).cast("int")).alias("others_rest"))
    out = inference.fisher_exact(t, ["season"], "draws_even", "others_even", "draws_rest", "others_rest")
    signal = F.when(F.col("p_value") < 0.05, "clear").otherwise("not clear")
    return out.withColumn("signal", signal).withColumn("p_value", r6("p_value"))


# two-sided normal p by Simpson's rule, written out for the checking SQL
_P_OF = ("1 - 2 * list_sum(list_transform(range(0, 401), lambda i: (case when i % 400 = 0 then 1 when i % 2 = 1 then 4 else 2 end) * "
         "exp(-power(i * ({z}) / 400.0, 2) / 2))) * ({z}) / 1200.0 / sqrt(2 * pi())")


@query("mann_whitney_phase", f"""WITH {V}, x AS (SELECT league, hy + hr + ay + ar AS v, (phase = 'playoff')::int AS f FROM v_match),
r AS (SELECT league, f, v, rank() OVER (PARTITION BY league ORDER BY v) + (count(*) OVER (PARTITION BY league, v) - 1) / 2.0 AS rk FROM x),
t AS (SELECT league, sum(c * c * c - c) AS ties FROM (SELECT league, v, cast(count(*) as double) AS c FROM x GROUP BY ALL) GROUP BY league),
s AS (SELECT league, sum(f) AS n1, count(*) - sum(f) AS n2, sum(rk * f) - sum(f) * (sum(f) + 1) / 2.0 AS u, any_value(ties) AS ties FROM r JOIN t USING (league) GROUP BY league)
SELECT league, cast(n1 as bigint) AS n1, cast(n2 as bigint) AS n2, round(u, 6) AS u,
  round(greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 0), 6) AS z,
  round({_P_OF.format(z='greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 0)')}, 6) AS p_value FROM s""")
def mann_whitney_phase(spark, sf):
    df = view(spark, sf, "v_match").withColumn("cards", F.expr("hy + hr + ay + ar")).withColumn(
        "first", F.col("phase") == "playoff")
    out = ranking.rank_sum_test(df, ["league"], "cards", "first")
    return _rounded(out, ["league", "n1", "n2"], ["u", "z", "p_value"])


@query("draw_rate_top_fifth", f"""WITH {_STACK}, c AS (SELECT model, quantile_cont(round(q_draw, 6), 0.8) AS edge FROM sr GROUP BY model)
SELECT model, count(*) AS n, round(avg(dr), 6) AS draw_rate FROM sr JOIN c USING (model) WHERE round(q_draw, 6) >= edge GROUP BY model""")
def draw_rate_top_fifth(spark, sf):
    st = evaluate.stack_models(evaluated(spark, sf), ["actual"], {"model": "p", "market": "m"}).withColumn(
        "q_draw", r6("q_draw"))
    edges = st.groupBy("model").agg(F.percentile("q_draw", F.lit(0.8)).alias("edge"))
    top = st.join(edges, "model").filter(F.col("q_draw") >= F.col("edge"))
    return top.groupBy("model").agg(F.count(F.lit(1)).alias("n"),
                                    r6(F.avg((F.col("actual") == "D").cast("int"))).alias("draw_rate"))


@query("rho_grid", f"""WITH {FORECAST}, g AS (SELECT match_id, lam, mu, least(hg, 10) AS gi, least(ag, 10) AS gj, r.r / 10.0 AS rho FROM ev,
  (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS r) r),
c AS (SELECT match_id, rho, gi, gj, i, j, greatest(exp(-lam + i * ln(lam) - lgamma(i + 1)) * exp(-mu + j * ln(mu) - lgamma(j + 1))
    * case when i = 0 and j = 0 then 1 - lam * mu * rho when i = 0 and j = 1 then 1 + lam * rho
      when i = 1 and j = 0 then 1 + mu * rho when i = 1 and j = 1 then 1 - rho else 1 end, 1e-12) AS p
  FROM g, (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS j)),
m AS (SELECT match_id, rho, ln(sum(case when i = gi and j = gj then p end) / sum(p)) AS ll FROM c GROUP BY ALL)
SELECT cast(rho as double) AS rho, round(sum(ll), 4) AS log_likelihood, count(*) AS matches FROM m GROUP BY rho""")
def rho_grid(spark, sf):
    out = scoreline.rho_log_likelihood(evaluated(spark, sf), "lam", "mu", "hg", "ag",
                                       [-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3])
    return out.withColumn("log_likelihood", F.round("log_likelihood", 4))


@query("form_last_five", f"""WITH {LNG}, p AS (SELECT league, team, match_id, match_date, case when gf > ga then 3 when gf = ga then 1 else 0 end AS pts FROM lng WHERE played)
SELECT league, team, match_id, round(avg(pts) OVER (PARTITION BY league, team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form FROM p""")
def form_last_five(spark, sf):
    from touchline.operators.ordered import number_rows, rolling_before
    from touchline.operators.reshape import team_rows

    rows = team_rows(matches(spark, sf).filter("played"), ["league", "match_id", "match_date"],
                     {"gf": ("hg", "ag"), "ga": ("ag", "hg")})
    rows = rows.withColumn("pts", F.expr("case when gf > ga then 3 when gf = ga then 1 else 0 end"))
    seq = number_rows(rows, ["league", "team"], "match_date", "match_id")
    out = rolling_before(seq, ["league", "team"], "seq", ["pts"], 5, 1)
    return out.select("league", "team", "match_id", r6("pts_prev").alias("form"))


@query("live_hit_trend", f"""WITH {_BLOCKS}, h AS (SELECT season, matchday, sum({_S['hit']}) AS hits, count(*) AS n FROM ev JOIN md USING (match_id) GROUP BY ALL)
SELECT season, matchday, n, round(sum(hits) OVER w / sum(n) OVER w, 6) AS rate_last_five FROM h
WINDOW w AS (PARTITION BY season ORDER BY matchday ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def live_hit_trend(spark, sf):
    from pyspark.sql import Window

    md = profiles.matchday_numbers(view(spark, sf, "v_match")).select("match_id", "matchday")
    s = evaluate.with_scores(evaluated(spark, sf), "p").join(md, "match_id")
    per = s.groupBy("season", "matchday").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("season").orderBy("matchday").rowsBetween(-4, 0)  # matchdays of a season
    return per.select("season", "matchday", "n", r6(F.sum("hits").over(w) / F.sum("n").over(w)).alias("rate_last_five"))


