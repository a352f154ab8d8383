"""Queries over on-ball events: places, territory, networks and participation."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.numeric import r6
from touchline.operators import inference, ranking, spatial
from touchline.plans.registry import query
from touchline.plans.views import ctes, view
from touchline.session import settle

E = ctes("v_events")
MIN_ACTIONS = 5
CELLS = spatial.CELLS
POS = f"""{E},
pos AS (SELECT match_id, team, player_id, any_value(player) AS player, any_value(block) AS block, bool_or(starter) AS starter, min(position) AS position, count(*) AS actions,
  sum((case type when 'Pass' then pass_outcome is null when 'Carry' then true when 'Dribble' then dribble_outcome = 'Complete' when 'Shot' then shot_outcome IN ('Goal', 'Saved')
    when 'Duel' then duel_outcome IN ('Won', 'Success In Play') else false end)::int) AS successes, avg(x) AS x, avg(y) AS y, stddev_samp(x) AS x_sd, stddev_samp(y) AS y_sd,
  min(minute) AS first_minute, max(minute) AS last_minute FROM v_events GROUP BY ALL HAVING count(*) >= {MIN_ACTIONS})"""
AREA = f"""{POS},
rs AS (SELECT p.*, c.cell, round(sqrt(power((c.cell % {CELLS} + 0.5) * 120.0 / {CELLS} - x, 2) + power((c.cell // {CELLS} + 0.5) * 80.0 / {CELLS} - y, 2)) / greatest(successes, 1), 9) AS v
  FROM pos p, (SELECT unnest(range({CELLS * CELLS})) AS cell) c),
ow AS (SELECT match_id, team, cell, min({{'v': v, 'p': player_id}}).p AS player_id FROM rs GROUP BY ALL),
ar AS (SELECT p.*, coalesce(n.area, 0) AS area FROM pos p LEFT JOIN (SELECT match_id, team, player_id, count(*) / {CELLS * CELLS}.0 AS area FROM ow GROUP BY ALL) n USING (match_id, team, player_id))"""
LINE = ("case when position = 'Goalkeeper' then 'Portero' when position IN ('Right Back', 'Left Back', 'Center Back') then 'Defensa' "
        "when position IN ('Center Midfield', 'Right Midfield', 'Left Midfield') then 'Medio' else 'Ataque' end")


def positions(spark, sf):
    return spatial.mean_positions(view(spark, sf, "v_events"), MIN_ACTIONS, ["starter", "block"])


def areas(spark, sf, mode="multiplicative"):
    return spatial.territory(settle(positions(spark, sf)), mode, CELLS)


def _round(df, keep, numbers):
    return df.select(*keep, *[r6(c).alias(c) for c in numbers])


@query("mean_positions", f"""WITH {POS} SELECT match_id, team, player_id, player, position, starter, actions, cast(successes as bigint) AS successes, first_minute, last_minute,
round(x, 6) AS x, round(y, 6) AS y, round(x_sd, 6) AS x_sd, round(y_sd, 6) AS y_sd, round(100.0 * successes / actions, 6) AS success_pct FROM pos""")
def mean_positions(spark, sf):
    return _round(positions(spark, sf), ["match_id", "team", "player_id", "player", "position", "starter", "actions",
                                         "successes", "first_minute", "last_minute"], ["x", "y", "x_sd", "y_sd", "success_pct"])


@query("territory", f"WITH {AREA} SELECT match_id, team, player_id, round(area, 6) AS area FROM ar")
def territory(spark, sf):
    return _round(areas(spark, sf), ["match_id", "team", "player_id"], ["area"])


@query("territory_gini", f"""WITH {AREA}, r AS (SELECT match_id, team, area AS v, count(*) OVER (PARTITION BY match_id, team) AS n, row_number() OVER (PARTITION BY match_id, team ORDER BY area) AS k FROM ar WHERE starter)
SELECT match_id, team, max(n) AS members, round(case when sum(v) > 0 then sum((2 * k - n - 1) * v) / (max(n) * sum(v)) end, 6) AS gini, round(max(v), 6) AS largest FROM r GROUP BY ALL""")
def territory_gini(spark, sf):
    return _round(spatial.team_concentration(settle(areas(spark, sf))), ["match_id", "team", "members"], ["gini", "largest"])


_CONCENTRATION = f"""{AREA}, gr AS (SELECT match_id, team, area AS v, count(*) OVER (PARTITION BY match_id, team) AS n, row_number() OVER (PARTITION BY match_id, team ORDER BY area) AS k FROM ar WHERE starter),
gt AS (SELECT match_id, team, round(case when sum(v) > 0 then sum((2 * k - n - 1) * v) / (max(n) * sum(v)) end, 6) AS gini, max(v) AS largest FROM gr GROUP BY ALL),
fo AS (SELECT match_id, team, concat_ws('-', count_if({LINE} = 'Defensa'), count_if({LINE} = 'Medio'), count_if({LINE} = 'Ataque')) AS formation FROM pos WHERE starter GROUP BY ALL),
go AS (SELECT match_id, team, count_if(shot_outcome = 'Goal') AS goals FROM v_events GROUP BY ALL),
gp AS (SELECT a.match_id, a.team, case when a.goals > b.goals then 3 when a.goals = b.goals then 1 else 0 end AS points FROM go a JOIN go b ON a.match_id = b.match_id AND a.team <> b.team),
co AS (SELECT * FROM gt JOIN fo USING (match_id, team) JOIN gp USING (match_id, team))"""


def concentration(spark, sf):
    """One row per team and match: Gini and largest cell of its starters' territory, formation and points."""
    p = settle(positions(spark, sf))
    events = view(spark, sf, "v_events")
    goals = events.groupBy("match_id", "team").agg(F.count_if(F.col("shot_outcome") == "Goal").alias("goals"))
    teams = spatial.team_concentration(settle(spatial.territory(p, "multiplicative", CELLS))).withColumn("gini", r6("gini"))
    key = ["match_id", "team"]
    return teams.join(spatial.formations(p), key).join(spatial.match_points(goals), key)


@query("concentration_quartiles", f"""WITH {_CONCENTRATION}, ed AS (SELECT round(quantile_cont(gini, 0.25), 9) AS a, round(quantile_cont(gini, 0.5), 9) AS b, round(quantile_cont(gini, 0.75), 9) AS c FROM co)
SELECT 1 + (gini > a)::int + (gini > b)::int + (gini > c)::int AS quartile, count(*) AS matches, round(avg(points), 6) AS points, round(avg(gini), 6) AS gini FROM co, ed WHERE gini IS NOT NULL GROUP BY ALL""")
def concentration_quartiles(spark, sf):
    return _round(spatial.points_by_quartile(settle(concentration(spark, sf))), ["quartile", "matches"], ["points", "gini"])


@query("concentration_formations", f"""WITH {_CONCENTRATION} SELECT formation, count(*) AS matches, round(avg(gini), 6) AS gini, round(avg(largest), 6) AS largest FROM co GROUP BY formation HAVING count(*) >= 3""")
def concentration_formations(spark, sf):
    return _round(spatial.concentration_by_formation(concentration(spark, sf), 3), ["formation", "matches"], ["gini", "largest"])


def _corr(x, y, cond="true", n=2):
    f = f"FILTER (WHERE {cond} AND {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"case when count(*) {f} >= {n} then covar_pop({x}, {y}) {f} / nullif(stddev_pop({x}) {f} * stddev_pop({y}) {f}, 0) end"


@query("territory_reliability", f"""WITH {AREA}, s AS (SELECT *, {LINE} AS line FROM ar WHERE starter),
d AS (SELECT *, area - avg(area) OVER (PARTITION BY position) AS minus_role, area - avg(area) OVER (PARTITION BY team, line) AS minus_team, area - avg(area) OVER (PARTITION BY team, position) AS minus_team_role,
  row_number() OVER (PARTITION BY player_id ORDER BY block, match_id) AS seq FROM s),
h AS (SELECT player_id, count(*) AS n, {', '.join(f'avg(case when seq % 2 = {k} then {c} end) AS {c}_{k}' for c in ('area', 'minus_role', 'minus_team', 'minus_team_role') for k in (0, 1))} FROM d GROUP BY player_id HAVING count(*) >= 4),
r AS (SELECT count(*) AS members, avg(n) AS rows_per_member, {', '.join(f"{_corr(f'{c}_0', f'{c}_1', n=3)} AS r_{c}" for c in ('area', 'minus_role', 'minus_team', 'minus_team_role'))} FROM h)
SELECT members, round(rows_per_member, 6) AS rows_per_member, {', '.join(f'round(r_{c}, 6) AS r_{c}, round(2 * r_{c} / (1 + r_{c}), 6) AS full_{c}' for c in ('area', 'minus_role', 'minus_team', 'minus_team_role'))} FROM r""")
def territory_reliability(spark, sf):
    cols = ["area", "minus_role", "minus_team", "minus_team_role"]
    v = settle(spatial.reliability_versions(settle(areas(spark, sf))))
    # the same player in many matches: numbered per day of play, never gathered in one task
    out = inference.split_half(v.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("block").cast("int"))),
                               "player_id", [], "day", "match_id", cols, 4)
    return _round(out, ["members"], ["rows_per_member", *[f"r_{c}" for c in cols], *[f"full_{c}" for c in cols]])


@query("role_change", f"""WITH {AREA}, s AS (SELECT *, {LINE} AS line FROM ar WHERE starter),
p AS (SELECT *, lead(area) OVER w AS an, lead(position) OVER w AS pn, lead(line) OVER w AS ln FROM s WINDOW w AS (PARTITION BY player_id ORDER BY block, match_id)),
g AS (SELECT *, case when position = pn then 'same_role' when line = ln then 'same_line' else 'changed_line' end AS grade FROM p WHERE an IS NOT NULL)
SELECT coalesce(line, 'ALL') AS line, count(*) AS pairs, {', '.join(f"count_if(grade = '{x}') AS n_{x}, round({_corr('area', 'an', f"grade = '{x}'", 10)}, 6) AS r_{x}" for x in ('same_role', 'same_line', 'changed_line'))} FROM g GROUP BY ROLLUP (line)""")
def role_change(spark, sf):
    a = settle(areas(spark, sf)).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("block").cast("int")))
    out = spatial.role_change(a, "day")
    grades = ("same_role", "same_line", "changed_line")
    return _round(out, ["line", "pairs", *[f"n_{g}" for g in grades]], [f"r_{g}" for g in grades])


@query("role_variance_explained", f"""WITH {AREA}, g AS (SELECT position, count(area) AS n, sum(area) AS s, sum(area * area) AS q FROM ar GROUP BY position)
SELECT count(*) AS "groups", cast(sum(n) as bigint) AS n, round(1 - sum(q - s * s / n) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS r2 FROM g""")
def role_variance_explained(spark, sf):
    return inference.variance_explained(areas(spark, sf), ["position"], "area").withColumn("r2", r6("r2"))


@query("border_cells", f"""WITH {AREA}, b AS (SELECT o.match_id, o.team, o.cell, coalesce(l.player_id <> o.player_id, false) OR coalesce(d.player_id <> o.player_id, false) AS border FROM ow o
LEFT JOIN ow l ON l.match_id = o.match_id AND l.team = o.team AND l.cell = o.cell - 1 AND o.cell % {CELLS} <> 0 LEFT JOIN ow d ON d.match_id = o.match_id AND d.team = o.team AND d.cell = o.cell - {CELLS})
SELECT match_id, team, count_if(border) AS border_cells FROM b GROUP BY ALL""")
def border_cells(spark, sf):
    p = settle(positions(spark, sf)).withColumn("w", F.greatest("successes", F.lit(1)).cast("double"))
    owned = spatial.owners(p, ["match_id", "team"], "player_id", "w", cells=CELLS, neighbours=True)
    b = spatial.borders(owned, "player_id")
    return b.groupBy("match_id", "team").agg(F.count_if("border").alias("border_cells"))


@query("complete_maps", f"""WITH {POS}, t AS (SELECT match_id, team, count(*) AS n FROM pos WHERE starter GROUP BY ALL), k AS (SELECT match_id FROM t GROUP BY match_id HAVING count(*) = 2 AND min(n) = 11)
SELECT match_id, count(*) AS players, count_if(starter) AS starters FROM pos WHERE match_id IN (SELECT match_id FROM k) GROUP BY match_id""")
def complete_maps(spark, sf):
    return spatial.complete_maps(positions(spark, sf)).groupBy("match_id").agg(
        F.count(F.lit(1)).alias("players"), F.count_if("starter").alias("starters"))


@query("pass_network", f"""WITH {E}, ps AS (SELECT *, team_no * 15 + (player_id + 1 + event_id % 5) % 15 AS receiver_id FROM v_events WHERE type = 'Pass'),
pl AS (SELECT match_id, team, player_id, avg(x) AS x, avg(y) AS y FROM ps GROUP BY ALL),
pr AS (SELECT match_id, team, player_id, receiver_id, count(*) AS passes FROM ps WHERE pass_outcome IS NULL GROUP BY ALL)
SELECT pr.*, round(a.x, 6) AS x, round(a.y, 6) AS y, round(b.x, 6) AS to_x, round(b.y, 6) AS to_y FROM pr JOIN pl a USING (match_id, team, player_id)
JOIN pl b ON b.match_id = pr.match_id AND b.team = pr.team AND b.player_id = pr.receiver_id""")
def pass_network(spark, sf):
    receiver = F.expr("team_no * 15 + (player_id + 1 + event_id % 5) % 15")
    passes = view(spark, sf, "v_events").filter("type = 'Pass'").withColumn(
        "receiver_id", F.when(F.col("pass_outcome").isNull(), receiver))
    return _round(spatial.pass_network(passes), ["match_id", "team", "player_id", "receiver_id", "passes"], ["x", "y", "to_x", "to_y"])


@query("density_grid", f"""WITH {E}, c AS (SELECT team, least(floor(x / 10), 11) AS cx, least(floor(y / 10), 7) AS cy, count(*) AS actions FROM v_events GROUP BY ALL)
SELECT team, cast(cx as bigint) AS cx, cast(cy as bigint) AS cy, actions, round(actions / sum(actions) OVER (PARTITION BY team), 6) AS share FROM c""")
def density_grid(spark, sf):
    return spatial.density_grid(view(spark, sf, "v_events"), ["team"]).withColumn("share", r6("share"))


@query("density_smoothed", f"""WITH {E}, c AS (SELECT team, least(floor(x / 10), 11) AS cx, least(floor(y / 10), 7) AS cy, count(*) AS actions FROM v_events GROUP BY ALL),
s AS (SELECT team, cx + i AS cx, cy + j AS cy, actions * exp(-(i * i + j * j) / 2.0) AS p FROM c, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j))
SELECT team, cast(cx as bigint) AS cx, cast(cy as bigint) AS cy, round(sum(p), 6) AS density FROM s WHERE cx BETWEEN 0 AND 11 AND cy BETWEEN 0 AND 7 GROUP BY ALL""")
def density_smoothed(spark, sf):
    return spatial.smoothed_grid(spatial.density_grid(view(spark, sf, "v_events"), ["team"]), ["team"]).withColumn("density", r6("density"))


@query("dispersion_ellipse", f"""WITH {E} SELECT team, player_id, count(*) AS actions, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(2 * stddev_samp(x), 6) AS x_axis, round(2 * stddev_samp(y), 6) AS y_axis
FROM v_events GROUP BY ALL""")
def dispersion_ellipse(spark, sf):
    return _round(spatial.dispersion_ellipse(view(spark, sf, "v_events"), ["team", "player_id"]), ["team", "player_id", "actions"],
                  ["x", "y", "x_axis", "y_axis"])


@query("shot_bands", f"""WITH {E} SELECT team, cast(floor(minute / 15) as bigint) AS band, count(*) AS events, cast(sum((shot_outcome = 'Goal')::int) as bigint) AS total FROM v_events WHERE type = 'Shot' GROUP BY ALL""")
def shot_bands(spark, sf):
    shots = view(spark, sf, "v_events").filter("type = 'Shot'")
    return spatial.minute_bands(shots, ["team"], (F.col("shot_outcome") == "Goal").cast("int"))


@query("shot_race", f"""WITH {E} SELECT match_id, team, event_id, round(sum(x / 120.0) OVER (PARTITION BY match_id, team ORDER BY minute, event_id), 6) AS running FROM v_events WHERE type = 'Shot'""")
def shot_race(spark, sf):
    from pyspark.sql import Window

    # shots of one team in one match are bounded by the length of a match
    w = Window.partitionBy("match_id", "team").orderBy("minute", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return view(spark, sf, "v_events").filter("type = 'Shot'").select(
        "match_id", "team", "event_id", r6(F.sum(F.col("x") / 120.0).over(w)).alias("running"))


_ST = """st AS (SELECT match_id, team, player_id, cast(0 as bigint) AS n, case when starter then '00:00' else lpad(cast(min(minute) as string), 2, '0') || ':30' end AS "from",
  case when max(minute) < 80 then lpad(cast(max(minute) as string), 2, '0') || ':45' end AS "to", case when starter then 'Starting XI' else 'Substitution - On' end AS start_reason,
  case when max(minute) < 80 then case player_id % 3 when 0 then 'Substitution - Off (Injury)' when 1 then 'Substitution - Off (Tactical)' else 'Player Off' end else 'Final Whistle' end AS end_reason
  FROM v_events GROUP BY match_id, team, player_id, starter)"""
_PART = f"""{E}, {_ST}, sm AS (SELECT *, cast(split_part("from", ':', 1) as double) + cast(split_part("from", ':', 2) as double) / 60 AS a,
  cast(nullif(split_part("to", ':', 1), '') as double) + cast(nullif(split_part("to", ':', 2), '') as double) / 60 AS b FROM st),
en AS (SELECT match_id, greatest(max(b), 90) AS e FROM sm GROUP BY match_id),
pt AS (SELECT match_id, team, player_id, coalesce(b, e) - a AS minutes, a AS entered, coalesce(b, e) AS "left", end_reason AS exit_reason,
  case when start_reason <> 'Starting XI' and a <> 0 then 'substitute' when contains(end_reason, 'Substitution - Off') then 'starter_replaced' when end_reason = 'Final Whistle' then 'starter_full' else 'starter_left' end AS state
  FROM sm JOIN en USING (match_id))"""


def stints(spark, sf):
    g = view(spark, sf, "v_events").groupBy("match_id", "team", "player_id", "starter").agg(
        F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    pad = "lpad(cast({} as string), 2, '0')"
    off = "case player_id % 3 when 0 then 'Substitution - Off (Injury)' when 1 then 'Substitution - Off (Tactical)' else 'Player Off' end"
    return g.selectExpr(
        "match_id", "team", "player_id", "cast(0 as bigint) AS n",
        f"case when starter then '00:00' else concat({pad.format('lo')}, ':30') end AS from",
        f"case when hi < 80 then concat({pad.format('hi')}, ':45') end AS to",
        "case when starter then 'Starting XI' else 'Substitution - On' end AS start_reason",
        f"case when hi < 80 then {off} else 'Final Whistle' end AS end_reason")


@query("stint_minutes", f"""WITH {_PART} SELECT match_id, team, player_id, round(minutes, 6) AS minutes, round(entered, 6) AS entered, round("left", 6) AS "left", state, exit_reason FROM pt""")
def stint_minutes(spark, sf):
    return _round(spatial.participation(stints(spark, sf)), ["match_id", "team", "player_id", "state", "exit_reason"],
                  ["minutes", "entered", "left"])


@query("exit_reasons", f"""WITH {_PART}, p AS (SELECT exit_reason, player_id, count(*) AS n FROM pt GROUP BY ALL)
SELECT exit_reason, cast(sum(n) as bigint) AS exits, count(*) AS players, count_if(n > 1) AS players_repeating FROM p GROUP BY exit_reason""")
def exit_reasons(spark, sf):
    return spatial.exits(spatial.participation(stints(spark, sf)))


@query("area_points_rank", f"""WITH {AREA}, x AS (SELECT block, round(area, 6) AS a, successes AS s FROM ar),
r AS (SELECT block, rank() OVER (PARTITION BY block ORDER BY a) + (count(*) OVER (PARTITION BY block, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY block ORDER BY s) + (count(*) OVER (PARTITION BY block, s) - 1) / 2.0 AS rs FROM x),
c AS (SELECT block, {_corr('ra', 'rs')} AS rho FROM r GROUP BY block)
SELECT count(*) AS blocks, round(quantile_cont(rho, 0.5), 6) AS median_rho FROM c""")
def area_points_rank(spark, sf):
    a = settle(areas(spark, sf).withColumn("a", r6("area")).select("block", "a", "successes"))
    return ranking.rank_correlation(a, ["block"], "a", "successes").agg(
        F.count(F.lit(1)).alias("blocks"), r6(F.percentile("rho", F.lit(0.5))).alias("median_rho"))


@query("concentration_points_rank", f"""WITH {_CONCENTRATION}, tm AS (SELECT team, round(avg(gini), 9) AS g, round(avg(points), 9) AS p FROM co GROUP BY team HAVING count(*) >= 3),
r AS (SELECT rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM tm)
SELECT count(*) AS teams, round({_corr('rg', 'rp')}, 6) AS rho FROM r""")
def concentration_points_rank(spark, sf):
    """Rank correlation over teams of mean concentration with points per match."""
    t = spatial.concentration_of_teams(concentration(spark, sf), ["team"], 3)
    t = settle(t.select(F.round("gini", 9).alias("gini"), F.round("points", 9).alias("points")))
    return ranking.rank_correlation(t, [], "gini", "points").select(F.col("pairs").alias("teams"), r6("rho").alias("rho"))


@query("event_windows", f"""WITH {E} SELECT type, cast(cast(time_bucket(interval 1 day, ts) as date) as string) AS day, count(*) AS actions, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM v_events GROUP BY ALL""")
def event_windows(spark, sf):
    return view(spark, sf, "v_events").groupBy("type", F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("actions"), r6(F.avg("x")).alias("x"), r6(F.avg("y")).alias("y")).select(
        "type", F.col("w.start").cast("date").cast("string").alias("day"), "actions", "x", "y")


PROFILE_SITES, PROFILE_CELLS = 20, 300
_VALUES = {"multiplicative": "d / points", "plain": "d", "additive": "d - w"}
_PROFILE = f"""{E}, pp AS (SELECT player_id, any_value(team_no // 2) AS season_no, any_value(team_no // 20) AS league_no, sum((type = 'Pass')::int) / 60.0 AS gx, sum((type = 'Shot')::int) / 60.0 AS gy, count(*) AS points FROM v_events GROUP BY player_id),
tp AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY season_no ORDER BY points DESC, player_id) <= {PROFILE_SITES}),
ap AS (SELECT *, gx / (1.05 * max(gx) OVER l) AS x, gy / (1.05 * max(gy) OVER l) AS y,
  case when max(points) OVER s > min(points) OVER s then 0.15 * (points - min(points) OVER s) / (max(points) OVER s - min(points) OVER s) else 0 end AS w
  FROM tp WINDOW l AS (PARTITION BY league_no), s AS (PARTITION BY season_no)),
ac AS (SELECT *, sqrt(power((cell % {PROFILE_CELLS} + 0.5) / {PROFILE_CELLS} - x, 2) + power((cell // {PROFILE_CELLS} + 0.5) / {PROFILE_CELLS} - y, 2)) AS d FROM ap, (SELECT unnest(range({PROFILE_CELLS ** 2})) AS cell)),
ao AS (SELECT season_no, cell, {', '.join(f"min({{'v': round({v}, 9), 'p': player_id}}).p AS {m}" for m, v in _VALUES.items())} FROM ac GROUP BY ALL),
an AS ({' UNION ALL '.join(f"SELECT season_no, {m} AS player_id, '{m}' AS mode, count(*) / {PROFILE_CELLS ** 2}.0 AS area FROM ao GROUP BY ALL" for m in _VALUES)}),
pa AS (SELECT a.season_no, a.player_id, any_value(a.points) AS points, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.w) AS w, {', '.join(f"coalesce(max(case when mode = '{m}' then area end), 0) AS {m}" for m in _VALUES)}
  FROM ap a LEFT JOIN an USING (season_no, player_id) GROUP BY ALL)"""


def profile_areas(spark, sf):
    """Players as points of a profile space with one domain per league, and their areas in each mode, season by season."""
    from touchline.operators.ordered import top_rows

    p = view(spark, sf, "v_events").groupBy("player_id").agg(
        F.floor(F.max("team_no") / 2).alias("season_no"), F.floor(F.max("team_no") / 20).alias("league_no"),
        (F.sum((F.col("type") == "Pass").cast("int")) / 60.0).alias("gx"),
        (F.sum((F.col("type") == "Shot").cast("int")) / 60.0).alias("gy"), F.count(F.lit(1)).alias("points"))
    top = settle(top_rows(p, ["season_no"], [F.desc("points"), F.asc("player_id")], PROFILE_SITES).drop("rank"))
    sites = settle(spatial.additive_weights("points", ["season_no"], spatial.fixed_domain(top, ["league_no"], "gx", "gy")))
    unit = ((0.0, 1.0), (0.0, 1.0))
    out = sites
    for mode, weight in (("multiplicative", "points"), ("plain", None), ("additive", "w")):
        owned = spatial.owners(sites, ["season_no"], "player_id", weight, mode, PROFILE_CELLS, unit)
        out = spatial.areas(out, owned, ["season_no"], "player_id", PROFILE_CELLS).withColumnRenamed("area", mode)
    return out


@query("profile_space_territory", f"""WITH {_PROFILE} SELECT season_no, player_id, points, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, {', '.join(f'round({m}, 6) AS {m}' for m in _VALUES)}, round(multiplicative - plain, 6) AS gain FROM pa""")
def profile_space_territory(spark, sf):
    """The areas of the first players of every season, and what their weight adds to the plain diagram's."""
    a = profile_areas(spark, sf).withColumn("gain", F.col("multiplicative") - F.col("plain"))
    return _round(a, ["season_no", "player_id", "points"], ["x", "y", "w", *_VALUES, "gain"])


_RANKED = ", ".join(f"rank() OVER (PARTITION BY season_no ORDER BY {c}) + (count(*) OVER (PARTITION BY season_no, {c}) - 1) / 2.0 AS r_{c}"
                    for c in (*_VALUES, "gain", "points"))


@query("profile_gain_rank", f"""WITH {_PROFILE}, pg AS (SELECT season_no, points, {', '.join(f'round({m}, 6) AS {m}' for m in _VALUES)}, round(multiplicative - plain, 6) AS gain FROM pa),
rk AS (SELECT season_no, {_RANKED} FROM pg), rc AS (SELECT season_no, {', '.join(f"{_corr(f'r_{c}', 'r_points')} AS {c}" for c in (*_VALUES, 'gain'))} FROM rk GROUP BY season_no)
SELECT count(*) AS seasons, {', '.join(f'round(quantile_cont({c}, 0.5), 6) AS {c}' for c in (*_VALUES, 'gain'))} FROM rc""")
def profile_gain_rank(spark, sf):
    """Median over seasons of the rank correlation with points: of each mode's area, and of the gain over the plain diagram."""
    a = settle(profile_space_territory(spark, sf))
    out = None
    for c in (*_VALUES, "gain"):
        rho = ranking.rank_correlation(a, ["season_no"], c, "points").select("season_no", F.col("rho").alias(c))
        out = rho if out is None else out.join(rho, "season_no")
    return out.agg(F.count(F.lit(1)).alias("seasons"), *[r6(F.percentile(c, F.lit(0.5))).alias(c) for c in (*_VALUES, "gain")])
