"""Queries over referees, bets, frozen predictions, the calendar and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text
from touchline.functions.numeric import r6
from touchline.operators import bets, competition, evaluate, inference, profiles, referees, scoreline, tracking
from touchline.plans.match_queries import FORECAST, MIN_PREV, RHO, WINDOW, matches
from touchline.plans.registry import query
from touchline.plans.sql_text import uniform_from
from touchline.plans.views import ctes, table, view

V = ctes("v_match")
BIAS = f"""{V}, mb AS (SELECT *, hy + hr + ay + ar AS cards, (hy + hr) - (ay + ar) AS bias, cast(hy + hr + ay + ar as double) / (hf + af) AS cpf, hr + ar AS reds FROM v_match)"""
BIAS_LONG = f"""{BIAS}, lg AS (SELECT league, referee, home AS team, hy + hr AS v, cast(hg as double) / nullif(hst, 0) AS e FROM mb
UNION ALL SELECT league, referee, away, ay + ar, cast(ag as double) / nullif(ast, 0) FROM mb)"""


def _m(spark, sf):
    return view(spark, sf, "v_match")


def _round(df, keep, numbers):
    return df.select(*keep, *[r6(c).alias(c) for c in numbers])


# --- referees -------------------------------------------------------------------------------------------------------

@query("referee_profile_z", f"""WITH {BIAS}, p AS (SELECT referee, count(*) AS matches, avg(cards) AS mean_cards, avg(bias) AS mean_bias, avg(cpf) AS cards_per_foul, avg(reds) AS reds_per_match
FROM mb GROUP BY referee HAVING count(*) >= 10), z AS (SELECT *, (mean_bias - avg(mean_bias) OVER ()) / nullif(stddev_samp(mean_bias) OVER (), 0) AS z_bias FROM p)
SELECT referee, matches, round(mean_cards, 6) AS mean_cards, round(mean_bias, 6) AS mean_bias, round(cards_per_foul, 6) AS cards_per_foul, round(reds_per_match, 6) AS reds_per_match,
round(z_bias, 6) AS z_bias, abs(z_bias) > 2 AS outlier FROM z""")
def referee_profile_z(spark, sf):
    return _round(referees.profile(_m(spark, sf), []), ["referee", "matches", "outlier"],
                  ["mean_cards", "mean_bias", "cards_per_foul", "reds_per_match", "z_bias"])


@query("referee_series", f"""WITH {BIAS}, s AS (SELECT referee, season, count(*) AS matches, avg(cards) AS mean_cards, avg(bias) AS mean_bias FROM mb GROUP BY ALL HAVING count(*) >= 5),
g AS (SELECT referee FROM s GROUP BY referee HAVING count(*) >= 2)
SELECT g.referee, x.season, s.matches, round(s.mean_cards, 6) AS mean_cards, round(s.mean_bias, 6) AS mean_bias FROM g
CROSS JOIN (SELECT unnest(range((SELECT min(season) FROM mb), (SELECT max(season) FROM mb) + 1)) AS season) x LEFT JOIN s ON s.referee = g.referee AND s.season = x.season""")
def referee_series(spark, sf):
    return _round(referees.season_series(_m(spark, sf)), ["referee", "season", "matches"], ["mean_cards", "mean_bias"])


def _pair_sql(v):
    return f"""WITH {BIAS_LONG}, p AS (SELECT league, referee, team, count({v}) AS n, sum({v}) AS s FROM lg GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY league, team) - n AS rn, sum(s) OVER (PARTITION BY league, team) - s AS rs FROM p)
SELECT league, referee, team, n, round(s / n + 1e-9, 6) AS with_referee, round(rs / rn + 1e-9, 6) AS with_others, round(s / n - rs / rn + 1e-9, 6) AS difference FROM q WHERE n >= 4 AND rn >= 4"""


def _off_ties(df):
    """Rounded a hair above, so that a sum's last bit does not decide an exact half."""
    return df.select("league", "referee", "team", "n", *[r6(F.col(c) + 1e-9).alias(c) for c in (
        "with_referee", "with_others", "difference")])


@query("referee_pair_vs_rest", _pair_sql("v"))
def referee_pair_vs_rest(spark, sf):
    return _off_ties(referees.pair_vs_rest(_m(spark, sf), ("h_cards", "a_cards")))


@query("referee_pair_shot_efficiency", _pair_sql("e"))
def referee_pair_shot_efficiency(spark, sf):
    m = _m(spark, sf).withColumns({"h_eff": F.expr("try_divide(cast(hg as double), hst)"),
                                   "a_eff": F.expr("try_divide(cast(ag as double), ast)")})
    return _off_ties(referees.pair_vs_rest(m, ("h_eff", "a_eff")))


@query("referee_extremes", f"""WITH {BIAS}, r AS (SELECT referee, match_id, home, away, bias, row_number() OVER (PARTITION BY referee ORDER BY bias, match_id) AS lo,
row_number() OVER (PARTITION BY referee ORDER BY bias DESC, match_id) AS hi FROM mb)
SELECT referee, match_id, home, away, bias, lo AS rank, 'low' AS "end" FROM r WHERE lo <= 6 AND bias < 0 UNION ALL
SELECT referee, match_id, home, away, bias, hi, 'high' FROM r WHERE hi <= 6 AND bias > 0""")
def referee_extremes(spark, sf):
    return referees.extremes(_m(spark, sf))[0]


@query("referee_most_favoured", f"""WITH {BIAS}, t AS (SELECT referee, case when bias < 0 then home else away end AS favoured, count(*) AS times FROM mb WHERE abs(bias) >= 4 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY referee ORDER BY times DESC, favoured) AS rn, sum(times) OVER (PARTITION BY referee) AS tot FROM t)
SELECT referee, cast(tot as bigint) AS extreme_matches, times AS favoured_times, favoured FROM r WHERE rn = 1""")
def referee_most_favoured(spark, sf):
    return referees.extremes(_m(spark, sf))[1]


@query("referee_season_trend", f"""WITH {BIAS} SELECT season, count(*) AS matches, round(avg(bias), 6) AS mean_bias, round(avg(cards), 6) AS mean_cards, round(avg(hg - ag), 6) AS mean_goal_diff,
round(avg((hg > ag)::int), 6) AS home_win_rate FROM mb WHERE played GROUP BY season""")
def referee_season_trend(spark, sf):
    return _round(referees.season_trend(_m(spark, sf).filter("played")), ["season", "matches"],
                  ["mean_bias", "mean_cards", "mean_goal_diff", "home_win_rate"])


@query("referee_by_phase", f"WITH {BIAS} SELECT referee, phase, count(*) AS matches, round(avg(cards), 6) AS mean_cards, round(avg(bias), 6) AS mean_bias FROM mb GROUP BY ALL")
def referee_by_phase(spark, sf):
    return _round(referees.by_phase(_m(spark, sf)), ["referee", "phase", "matches"], ["mean_cards", "mean_bias"])


@query("referee_confounding", f"""WITH {BIAS_LONG}, n AS (SELECT referee, team, count(*) AS n FROM lg GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY referee ORDER BY n DESC, team) AS rn, sum(n) OVER (PARTITION BY referee) AS tot FROM n)
SELECT referee, cast(tot as bigint) AS appearances, round(n / tot, 6) AS max_share, team FROM r WHERE rn = 1""")
def referee_confounding(spark, sf):
    return _round(referees.largest_team_share(_m(spark, sf)), ["referee", "appearances", "team"], ["max_share"])


@query("referee_new_names", f"WITH {V} SELECT DISTINCT referee FROM v_match WHERE referee NOT IN (SELECT referee FROM v_match WHERE match_date < date '1995-02-01')")
def referee_new_names(spark, sf):
    return referees.new_names(_m(spark, sf), _m(spark, sf).filter("match_date < date '1995-02-01'").select("referee").distinct())


_SIMS = 10_000


@query("referee_null_spread", f"""WITH {V}, al AS (SELECT cast(substr(referee, 2) as bigint) AS no, count(*) AS n, sum((hg > ag)::int) AS w FROM v_match WHERE played GROUP BY ALL),
g AS (SELECT * FROM al WHERE n >= 10), p AS (SELECT sum(w) / sum(n) AS rate FROM al), o AS (SELECT max(w / n) - min(w / n) AS seen FROM g),
tm AS (SELECT no, n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(rate) + (n - k) * ln(1 - rate)) AS q FROM (SELECT no, n, unnest(range(0, n + 1)) AS k FROM g), p),
cd AS (SELECT no, n, k, sum(q) OVER (PARTITION BY no ORDER BY k) AS c FROM tm),
u AS (SELECT no, n, world, u FROM {uniform_from(f'g, (SELECT unnest(range({_SIMS})) AS world)', 'u', 7, 'no', 'world')}),
d AS (SELECT u.no, u.n, world, coalesce(k + 1, 0) AS k FROM u ASOF LEFT JOIN cd ON u.no = cd.no AND u.u >= cd.c),
s AS (SELECT world, max(least(k, n) / n) - min(least(k, n) / n) AS rg FROM d GROUP BY world)
SELECT round((SELECT seen FROM o), 6) AS observed_range, round(quantile_cont(rg, 0.5), 6) AS chance_median, round(quantile_cont(rg, 0.95), 6) AS chance_p95,
round(avg((rg >= (SELECT seen FROM o) - 1e-12)::int), 6) AS p_value FROM s""")
def referee_null_spread(spark, sf):
    g = _m(spark, sf).filter("played").groupBy("referee").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("hg") > F.col("ag")).cast("int")).alias("w"))
    g = g.withColumn("no", F.substring("referee", 2, 20).cast("bigint"))
    return _round(inference.null_spread(g, "no", "n", "w", _SIMS), [],
                  ["observed_range", "chance_median", "chance_p95", "p_value"])


# --- bets -----------------------------------------------------------------------------------------------------------

BETS = f"""{ctes('v_bets').replace(V + ',', '')}"""
LEGS = f"""{FORECAST}, {BETS[BETS.index('v_bets AS'):]},
lg0 AS (SELECT b.*, case odds_text when '+150' then 2.5 when '-120' then 1 + 100 / 120.0 when '5/2' then 3.5 else 1.85 end AS odds,
  case stake_text when '$100' then 100.0 when '1,000' then 1000.0 else 50.0 end AS stake, mm.hg, mm.ag, mm.hy + mm.hr + mm.ay + mm.ar AS cards, mm.hc + mm.ac AS corners
  FROM v_bets b JOIN mm USING (match_id)),
lg1 AS (SELECT *, case when hg > ag then 'Local' when hg < ag then 'Visitante' else 'Empate' end AS res,
  case kind when 'over_under_goles' then hg + ag when 'tarjetas_over_under' then cards when 'corners_over_under' then corners end AS total FROM lg0),
legs AS (SELECT * EXCLUDE (res, total), case when hg is null then 'pendiente'
  when kind = '1x2' then case when selection = res then 'gano' else 'perdio' end
  when kind = 'doble_oportunidad' then case when (selection = '1X' and res <> 'Visitante') or (selection = 'X2' and res <> 'Local') or (selection = '12' and res <> 'Empate') then 'gano' else 'perdio' end
  when total is not null then case when total = line then 'push' when (total > line) = (selection = 'over') then 'gano' else 'perdio' end
  when kind = 'ambos_anotan' then case when (hg > 0 and ag > 0) = (selection = 'si') then 'gano' else 'perdio' end
  when kind = 'handicap' then case when line = floor(line) then 'no calificable' when selection = 'Local' then case when hg + line > ag then 'gano' else 'perdio' end
    else case when ag + line > hg then 'gano' else 'perdio' end end
  when kind = 'marcador_exacto' then case when replace(selection, ' ', '') = concat(cast(hg as string), '-', cast(ag as string)) then 'gano' else 'perdio' end
  else 'no calificable' end AS state FROM lg1)"""


def legs(spark, sf):
    m = matches(spark, sf).select("match_id", "hg", "ag", F.expr("hy + hr + ay + ar").alias("cards"),
                                  F.expr("hc + ac").alias("corners"))
    b = view(spark, sf, "v_bets").withColumns({"odds": text.decimal_odds("odds_text"), "stake": text.money("stake_text")})
    return bets.settle_legs(b.join(m, "match_id"))


def priced_legs(spark, sf):
    prof = profiles.match_profiles(matches(spark, sf), WINDOW, MIN_PREV, metrics={
        k: profiles.METRICS[k] for k in ("goals_for", "goals_against", "cards")})
    exp = scoreline.naive_expectations(prof).filter("lam IS NOT NULL AND mu IS NOT NULL")
    fc = scoreline.outcome_probabilities(exp, "lam", "mu", RHO)
    pick = text.lookup("_p", {"H": "Local", "D": "Empate", "A": "Visitante"})
    fc = fc.withColumn("_p", evaluate.pick("p")).select(
        "match_id", "lam", "mu", "p_home", "p_draw", "p_away", (F.col("home_cards") + F.col("away_cards")).alias("expected_cards"),
        pick.alias("model_pick"))
    return bets.with_edge(bets.model_probability(legs(spark, sf).join(fc, "match_id", "left"), RHO))


@query("bet_settlement", f"WITH {LEGS} SELECT bet_id, kind, selection, round(line, 6) AS line, round(odds, 6) AS odds, stake, state FROM legs")
def bet_settlement(spark, sf):
    return _round(legs(spark, sf), ["bet_id", "kind", "selection", "stake", "state"], ["line", "odds"])


PRICED = f"""{LEGS}, pc AS (SELECT l.bet_id, sum(c.p) AS tot,
  sum(case when kind = 'over_under_goles' and (i + j > line) = (selection = 'over') then c.p when kind = 'ambos_anotan' and (i > 0 and j > 0) = (selection = 'si') then c.p
    when kind = 'handicap' and ((selection = 'Local' and i + line > j) or (selection = 'Visitante' and j + line > i)) then c.p
    when kind = 'marcador_exacto' and concat(cast(i as string), '-', cast(j as string)) = replace(selection, ' ', '') then c.p else 0 end) AS s
  FROM legs l JOIN cells c USING (match_id) GROUP BY l.bet_id),
xc AS (SELECT h.match_id, h.cards + a.cards AS xc FROM prof h JOIN prof a ON a.match_id = h.match_id AND a.side = 'A' WHERE h.side = 'H'),
pd AS (SELECT l.*, fc.p_home, fc.p_draw, fc.p_away, case when fc.lam is null then null when kind = '1x2' then case selection when 'Local' then p_home when 'Empate' then p_draw else p_away end
  when kind = 'doble_oportunidad' then case selection when '1X' then p_home + p_draw when 'X2' then p_draw + p_away else p_home + p_away end
  when kind = 'tarjetas_over_under' then case when selection = 'over' then 1 else 0 end + (case when selection = 'over' then -1 else 1 end) *
    list_sum(list_transform(range(cast(floor(line) as bigint) + 1), lambda k: exp(-xc + k * ln(greatest(xc, 1e-300)) - lgamma(k + 1))))
  when kind in ('over_under_goles', 'ambos_anotan', 'handicap', 'marcador_exacto') then s / tot end AS p_model,
  case when fc.lam is null then null when round(p_draw, 9) >= round(p_home, 9) and round(p_draw, 9) >= round(p_away, 9) then 'Empate' when round(p_home, 9) >= round(p_away, 9) then 'Local' else 'Visitante' end AS model_pick
  FROM legs l LEFT JOIN fc USING (match_id) LEFT JOIN pc USING (bet_id) LEFT JOIN xc USING (match_id))"""


@query("bet_model_prob", f"""WITH {PRICED} SELECT bet_id, round(p_model, 6) AS p_model, round(1 / odds, 6) AS p_implied, round(p_model - 1 / odds, 6) AS edge,
case when kind = '1x2' then (selection = model_pick)::int end AS agrees FROM pd""")
def bet_model_prob(spark, sf):
    return _round(priced_legs(spark, sf).withColumn("agrees", F.col("agrees").cast("int")), ["bet_id", "agrees"], ["p_model", "p_implied", "edge"])


COMBO = f"""{LEGS}, un AS (SELECT coalesce(combo_id, concat('S', cast(bet_id as string))) AS unit, min(match_date) AS match_date, min(league) AS league, count(*) AS legs,
  case when max(combo_id) is not null then 'combinada' else max(kind) end AS kind,
  case when count_if(state = 'perdio') > 0 then 'perdio' when count_if(state = 'pendiente') > 0 then 'pendiente' when count_if(state = 'no calificable') > 0 then 'no calificable'
    when max(combo_id) is null and count_if(state = 'push') > 0 then 'push' else 'gano' end AS state,
  case when max(combo_id) is null then max(odds) else coalesce(exp(sum(case when state <> 'push' then ln(odds) end)), 1.0) end AS odds, max(stake) AS stake FROM legs GROUP BY 1)"""


@query("bet_combos", f"WITH {COMBO} SELECT unit, cast(match_date as string) AS match_date, legs, kind, state, round(odds + 1e-9, 4) AS odds, stake FROM un")
def bet_combos(spark, sf):
    out = bets.combine(legs(spark, sf).withColumn("edge", F.lit(None).cast("double")))
    return out.select("unit", F.col("match_date").cast("string").alias("match_date"), "legs", "kind", "state",
                      F.round(F.col("odds") + 1e-9, 4).alias("odds"), "stake")


_BAND = "case when odds <= 1.5 then '<1.5' when odds <= 2 then '1.5-2' when odds <= 3 then '2-3' else '>=3' end"
_SLICES = {"kind": "kind", "odds_band": _BAND, "structure": "case when legs = 1 then 'single' when legs < 4 then concat('combination ', cast(legs as string)) else 'combination 4+' end",
           "weekday": "cast((datediff_mon % 7) as string)"}


def _slice_sql(name, expr):
    expr = expr.replace("datediff_mon", "(cast(match_date as date) - date '1990-01-01')")
    return f"""SELECT '{name}' AS slice, {expr} AS value, count(*) AS n, round(avg((state = 'gano')::int), 6) AS hit_rate, round(avg(1 / odds), 6) AS mean_implied,
round(sum(case when state = 'gano' then stake * (odds - 1) else -stake end) + 1e-6, 3) AS profit, round(sum(stake), 4) AS staked,
round(sum(case when state = 'gano' then stake * (odds - 1) else -stake end) / sum(stake), 6) AS roi, count(*) < 30 AS noise FROM un WHERE state IN ('gano', 'perdio') GROUP BY ALL"""


@query("bet_roi", f"WITH {COMBO} " + " UNION ALL ".join(_slice_sql(k, v) for k, v in _SLICES.items()))
def bet_roi(spark, sf):
    units = bets.combine(legs(spark, sf).withColumn("edge", F.lit(None).cast("double")))
    slices = {k: F.expr(v.replace("datediff_mon", "datediff(match_date, date '1990-01-01')")) for k, v in _SLICES.items()}
    out = bets.returns_by_slice(units, slices)
    return out.select("slice", "value", "n", "noise", r6("hit_rate").alias("hit_rate"), r6("mean_implied").alias("mean_implied"),
                      F.round(F.col("profit") + 1e-6, 3).alias("profit"), F.round("staked", 4).alias("staked"), r6("roi").alias("roi"))


@query("expected_value_kelly", f"""WITH {FORECAST} SELECT match_id, round(p_home * odds_h - 1, 6) AS ev, round(greatest(0, (p_home * odds_h - 1) / (odds_h - 1)), 6) AS fraction FROM ev""")
def expected_value_kelly(spark, sf):
    from touchline.plans.match_queries import evaluated

    ev, fraction = bets.value_and_fraction("p_home", "odds_h")
    return evaluated(spark, sf).select("match_id", r6(ev).alias("ev"), r6(fraction).alias("fraction"))


# --- frozen predictions ---------------------------------------------------------------------------------------------

NOW = "2000-07-01 11:31:00"
_KICK = "case match_id % 5 when 0 then null when 1 then '12:30' when 2 then '15:00' when 3 then '20:45' else '12:31' end"


def _now():
    return F.lit(NOW).cast("timestamp")


def _future(spark, sf):
    from touchline.plans.match_queries import forecasts

    return forecasts(spark, sf).filter("NOT played").withColumns(
        {"kickoff": F.expr(_KICK), "no_profile": F.col("match_id") % 13 == 0})


def _register(df):
    return df.filter("match_id % 7 = 0")


# London and Mexico City are UTC+1 and UTC-5 on the days compared here
_STARTED = f"(case when kickoff is not null then cast(concat(cast(match_date as string), ' ', kickoff, ':00') as timestamp) - interval 1 hour <= timestamp '{NOW}' else match_date < date '2000-07-01' end)"
FUT = f"{FORECAST}, fu AS (SELECT *, {_KICK} AS kickoff, match_id % 13 = 0 AS no_profile FROM fc WHERE NOT played)"


@query("freeze_candidates", f"""WITH {FUT} SELECT match_id, cast(match_date as string) AS match_date, home, away, round(p_home, 6) AS p_home, greatest(p_draw, p_home, p_away) - least(p_draw, p_home, p_away) <= 0.125 AS even,
match_date >= date '2000-07-10' AS counts_live FROM fu f WHERE NOT no_profile AND NOT {_STARTED} AND match_date <= date '2000-07-01' + 60
AND NOT EXISTS (SELECT 1 FROM fu r WHERE r.match_id % 7 = 0 AND r.match_date = f.match_date AND r.home = f.home AND r.away = f.away)""")
def freeze_candidates(spark, sf):
    f = _future(spark, sf)
    rows = tracking.to_freeze(f, _register(f), _now(), "Europe/London", 60)
    rec = tracking.freeze_record(rows, _now(), F.lit("2000-07-10").cast("date"), "poisson")
    return rec.select("match_id", F.col("match_date").cast("string").alias("match_date"), "home", "away",
                      r6("p_home").alias("p_home"), "even", "counts_live")


@query("unattended_leagues", f"""WITH {FUT} SELECT league, count(*) AS fixtures, cast(min(match_date) as string) AS first_date FROM fu f
WHERE NOT {_STARTED} AND match_date <= date '2000-07-01' + 60
AND NOT EXISTS (SELECT 1 FROM fu r WHERE (r.match_id % 7 = 0 OR r.no_profile) AND r.match_date = f.match_date AND r.home = f.home AND r.away = f.away) GROUP BY league""")
def unattended_leagues(spark, sf):
    f = _future(spark, sf)
    return tracking.leagues_needing_work(tracking.unattended(f, _register(f), f.filter("no_profile"), _now(), "Europe/London", 60))


OVER = f"""{FORECAST}, k AS (SELECT match_date, home, away, max(round(p_home, 2)) AS fh, max(round(p_draw, 2)) AS fd, max(round(p_away, 2)) AS fa FROM fc WHERE match_id % 3 = 0 GROUP BY ALL),
ov AS (SELECT fc.match_id, fc.season, fc.match_date, fc.actual, coalesce(fh, p_home) AS p_home, coalesce(fd, p_draw) AS p_draw, coalesce(fa, p_away) AS p_away, fh is not null AS frozen,
  fh is not null AND fc.match_date >= date '1998-01-01' AS live,
  case when round(p_draw, 9) >= round(p_home, 9) and round(p_draw, 9) >= round(p_away, 9) then 'D' when round(p_home, 9) >= round(p_away, 9) then 'H' else 'A' end AS pick
  FROM fc LEFT JOIN k USING (match_date, home, away))"""


def _overlaid(spark, sf):
    from touchline.plans.match_queries import forecasts

    fc = forecasts(spark, sf).withColumn("pick", evaluate.pick("p"))
    reg = fc.filter("match_id % 3 = 0").groupBy(*tracking.KEY).agg(
        *[F.max(F.round(f"p_{k}", 2)).alias(f"p_{k}") for k in ("home", "draw", "away")])
    reg = reg.withColumn("counts_live", F.col("match_date") >= F.lit("1998-01-01").cast("date"))
    return tracking.overlay(fc, reg, ["p_home", "p_draw", "p_away"])


@query("overlay_frozen", f"WITH {OVER} SELECT match_id, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away, frozen, live, case when actual is not null then (pick = actual)::int end AS hit FROM ov")
def overlay_frozen(spark, sf):
    return _round(_overlaid(spark, sf).withColumn("hit", F.col("hit").cast("int")), ["match_id", "frozen", "live", "hit"], ["p_home", "p_draw", "p_away"])


_EVEN = "round(greatest(p_home, p_draw, p_away) - least(p_home, p_draw, p_away), 9) <= 0.125"


@query("live_summary", f"""WITH {OVER} SELECT season, count(*) AS played, count_if(pick = actual) AS hits, round(avg((actual = 'H')::int), 6) AS home_baseline, count_if({_EVEN}) AS even_matches,
count_if({_EVEN} AND actual = 'D') AS draws_in_even, cast(min(match_date) as string) AS first_date FROM ov WHERE live AND actual is not null GROUP BY season""")
def live_summary(spark, sf):
    t = _overlaid(spark, sf).withColumns({f"p_{k}": F.round(f"p_{k}", 9) for k in ("home", "draw", "away")})
    return tracking.live_summary(t, ["season"]).withColumn("home_baseline", r6("home_baseline"))


@query("unresolved_alarm", f"""WITH {V}, l AS (SELECT league, max(match_date) AS last FROM v_match WHERE played AND match_date <= date '2000-07-01' GROUP BY league)
SELECT league, count(*) AS waiting, cast(min(match_date) as string) AS "from", cast(max(match_date) as string) AS "to", cast(max(last) as string) AS last_result
FROM v_match JOIN l USING (league) WHERE match_date <= date '2000-07-30' AND match_date > last AND match_id % 2 = 0 GROUP BY league""")
def unresolved_alarm(spark, sf):
    m = _m(spark, sf)
    results = m.filter("played AND match_date <= date'2000-07-01'")
    return tracking.unresolved(m.filter("match_id % 2 = 0"), results, F.lit("2000-08-01").cast("date"))


@query("freshness", f"WITH {V} SELECT league, cast(date '2002-01-01' - max(match_date) as bigint) AS days_since_result FROM v_match WHERE played GROUP BY league")
def freshness(spark, sf):
    return tracking.freshness(_m(spark, sf).filter("played"), F.lit("2002-01-01").cast("date"))


# --- calendar and names ---------------------------------------------------------------------------------------------

CAL = f"""{V}, c0 AS (SELECT league_no % 6 AS comp, season, cast(floor((month_no - 1) / 3) as bigint) AS qt, min(match_date) AS s FROM v_match GROUP BY ALL),
cal AS (SELECT comp * 1000 + (season % 100) * 10 + qt AS row_id, case when (comp + qt) % 4 = 0 then 'ventana' else 'torneo' end AS kind, concat('C', cast(comp as string)) AS competition,
  concat(cast(season as string), '-', cast(qt as string)) AS edition, concat('P', cast(qt as string)) AS phase, case when comp % 2 = 0 then 'seleccion' else 'club' end AS scope,
  s AS "start", s + cast(20 + (comp * 13 + qt * 7 + season) % 40 as int) AS "end", season >= 2000 AS provisional FROM c0)"""


def calendar(spark, sf):
    """A calendar of competition editions drawn from all matches: one row per competition, season and quarter."""
    c = _m(spark, sf).groupBy((F.col("league_no") % 6).alias("comp"), "season",
                              F.floor((F.col("month_no") - 1) / 3).alias("qt")).agg(F.min("match_date").alias("start"))
    c = c.selectExpr(
        "comp * 1000 + (season % 100) * 10 + qt AS row_id", "case when (comp + qt) % 4 = 0 then 'ventana' else 'torneo' end AS kind",
        "concat('C', comp) AS competition", "concat(season, '-', qt) AS edition", "concat('P', qt) AS phase",
        "case when comp % 2 = 0 then 'seleccion' else 'club' end AS scope", "start",
        "date_add(start, cast(20 + (comp * 13 + qt * 7 + season) % 40 as int)) AS end",
        "case when season >= 2000 then 'provisional' else 'si' end AS confirmed")
    return competition.calendar_columns(c)


@query("calendar_overlaps", f"""WITH {CAL} SELECT concat(a.competition, ' ', a.edition) AS competition_a, concat(b.competition, ' ', b.edition) AS competition_b,
cast(greatest(a."start", b."start") as string) AS "from", cast(least(a."end", b."end") as string) AS "to", least(a."end", b."end") - greatest(a."start", b."start") + 1 AS overlap_days,
a.provisional OR b.provisional AS any_provisional FROM cal a JOIN cal b ON a.row_id < b.row_id AND a.competition <> b.competition AND a.kind = 'torneo' AND b.kind = 'torneo'
AND a."start" <= b."end" AND b."start" <= a."end" """)
def calendar_overlaps(spark, sf):
    out = competition.overlaps(calendar(spark, sf))
    return out.withColumns({"from": F.col("from").cast("string"), "to": F.col("to").cast("string")})


@query("window_contents", f"""WITH {CAL}, o AS (SELECT a.row_id, string_agg(concat(b.competition, ' (', b.phase, ')'), ' + ' ORDER BY b."start", b.row_id) AS x FROM cal a JOIN cal b ON a.kind = 'ventana' AND b.kind = 'torneo'
AND a."start" <= b."end" AND b."start" <= a."end" GROUP BY a.row_id)
SELECT cal.competition, edition, cast("start" as string) AS "start", cast("end" as string) AS "end", "end" - "start" + 1 AS days, coalesce(x, '—') AS occupied_by FROM cal LEFT JOIN o USING (row_id) WHERE kind = 'ventana'""")
def window_contents(spark, sf):
    out = competition.window_contents(calendar(spark, sf).withColumn("phase_", F.col("competition")).withColumn(
        "edition", F.when(F.col("kind") == "ventana", F.concat_ws("|", "competition", "edition")).otherwise(F.col("edition"))))
    return out.select(F.split_part("edition", F.lit("|"), F.lit(1)).alias("competition"),
                      F.split_part("edition", F.lit("|"), F.lit(2)).alias("edition"), F.col("start").cast("string").alias("start"),
                      F.col("end").cast("string").alias("end"), "days", "occupied_by")


@query("countdown", f"""WITH {CAL} SELECT competition, edition, scope, greatest("start" - date '1996-10-10', 0) AS days_to_start, "start" <= date '1996-10-10' AS under_way, provisional FROM cal
WHERE kind = 'torneo' AND "end" >= date '1996-10-10' AND "start" < date '2001-01-01' AND scope = 'seleccion'""")
def countdown(spark, sf):
    out = competition.countdown(calendar(spark, sf), F.lit("1996-10-10").cast("date"), F.lit("2001-01-01").cast("date"), "seleccion")
    return out.select("competition", "edition", "scope", "days_to_start", "under_way", "provisional")


@query("active_window", f"""WITH {CAL} SELECT competition, edition FROM cal WHERE kind = 'ventana' AND "start" - 1 <= date '1996-10-10' AND date '1996-10-10' <= "end" + 3""")
def active_window(spark, sf):
    return competition.active_windows(calendar(spark, sf), F.lit("1996-10-10").cast("date")).select("competition", "edition")


_NAMES = """nl AS (SELECT DISTINCT p_brand AS brand, p_name AS name FROM part), nr AS (SELECT DISTINCT p_brand AS brand, concat(split_part(p_name, ' ', 2), ' ', substr(p_name, 1, 3), ' fc') AS name FROM part),
lt AS (SELECT brand, name, unnest(string_split(name, ' ')) AS w FROM nl), rt AS (SELECT brand, name, unnest(list_filter(string_split(name, ' '), lambda x: x <> 'fc' and x <> '')) AS w FROM nr),
pr AS (SELECT lt.brand, lt.name AS left_name, rt.name AS right_name, count(DISTINCT lt.w) AS score FROM lt JOIN rt ON lt.brand = rt.brand AND (lt.w = rt.w OR (length(lt.w) >= 3 AND length(rt.w) >= 3 AND (starts_with(lt.w, rt.w) OR starts_with(rt.w, lt.w)))) GROUP BY ALL),
tp AS (SELECT * FROM pr QUALIFY score = max(score) OVER (PARTITION BY brand, left_name)),
sg AS (SELECT brand, left_name, count(*) AS c, min(right_name) AS right_name, max(score) AS score FROM tp GROUP BY ALL),
cm AS (SELECT brand, right_name, count(*) AS claims FROM sg WHERE c = 1 GROUP BY ALL)"""


@query("team_name_match", f"""WITH {_NAMES} SELECT n.brand, n.name AS left_name, case when c is null then 'no match' when c > 1 then 'ambiguous' when claims > 1 then 'collision' else 'matched' end AS state,
case when c = 1 and claims = 1 then s.right_name end AS right_name, score FROM nl n LEFT JOIN sg s ON s.brand = n.brand AND s.left_name = n.name LEFT JOIN cm ON cm.brand = s.brand AND cm.right_name = s.right_name AND s.c = 1""")
def team_name_match(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_name").distinct()
    left = p.select("brand", F.col("p_name").alias("name"))
    right = p.select("brand", F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), F.substring("p_name", 1, 3), F.lit(" fc")).alias("name"))
    return competition.match_names(left, right, "brand")
