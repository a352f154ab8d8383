"""Hand-made rows for the panel, leagues, pitch, tracking, feeds, articles, bets and writers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import bets, competition, fantasy, league, panel, reshape, scouting, spatial, tracking
from touchline.sources import articles, sinks
from touchline.schemas import documented

PANEL = ("ranker bigint, player string, nationality string, position string, team string, league string, season string, age string, "
         "birth_year double, games double, games_starts double, minutes string, minutes_90s double, goals double, assists double, "
         "pens_made double, pens_att double, cards_yellow double, cards_red double, goals_assists double, goals_pens double, "
         "player_id string, team_id string")


def row(ranker, player, pid, team="Toluca", tid="t1", games=10.0, starts=8.0, minutes="700", goals=4.0, assists=2.0, made=0.0, att=0.0,
        year=1998.0, position="FW,MF", age="25", season="2023-2024"):
    return (ranker, player, "mx MEX", position, team, "Liga MX", season, age, year, games, starts, minutes, 7.8, goals, assists, made, att,
            1.0, 0.0, None if assists is None else goals + assists, goals - made, pid, tid)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [row(1, "Raúl Pérez", "aaaaaaaa"), row(2, "Raúl Pérez", "aaaaaaaa", "América", "t2", 5.0, 4.0, "350", 2.0, 1.0),
            row(3, "Juan Gil", "bbbbbbbb"), row(4, "Juan Gil", "cccccccc"),
            row(5, "Luis Roa", "1e345678", games=30.0, starts=30.0, minutes="2,700", goals=10.0, assists=None, made=1.0, att=0.0),
            row(6, "Sin Página", "Sin-Pagina", year=None, age="30-284")]
    return spark.createDataFrame(rows, PANEL)


def test_cleaning_repairs_counts_and_drops_copies(raw):
    out = {r.player_key: r for r in panel.clean(raw, {"cccccccc": "bbbbbbbb"}).collect() if r.player != "Raúl Pérez"}
    assert len(out) == 3
    r = out["1e345678"]
    assert (r.minutes, r.assists, r.pens_att, r.main_position) == (2700.0, 0.0, 1.0, "FW")
    assert out["Sin-Pagina"].provisional_id and out["Sin-Pagina"].age == 30.0


def test_a_transfer_adds_up_in_order_of_minutes(raw):
    r = panel.by_season(panel.clean(raw)).filter("player = 'Raúl Pérez'").first()
    assert (r.games, r.minutes, r.goals, r.teams, r.main_team) == (15.0, 1050.0, 6.0, "Toluca / América", "Toluca")


def test_missing_id_switches_everyone_to_name_keys(raw):
    one_gone = raw.withColumn("player_id", F.when(F.col("ranker") != 3, F.col("player_id")))
    keys = {r.player_key for r in panel.clean(one_gone).select("player_key").collect()}
    assert "raul-perez|1998|MEX" in keys and "sin-pagina|na|MEX" in keys


def test_offensive_points_by_hand(raw):
    pts = {r.player: r.pts_total for r in fantasy.offensive_points(panel.by_season(panel.clean(raw))).collect()}
    # 12 starts and 3 from the bench, 6 goals of a forward, 3 assists, 2 yellows
    assert pts["Raúl Pérez"] == 2 * 12 + 3 + 4 * 6 + 3 * 3 - 2
    assert pts["Luis Roa"] == 60 + 40 - 1


def test_extras_keep_missing_apart_from_zero(spark, raw):
    pt = spark.createDataFrame([("Liga MX", "2023-2024", "aaaaaaaa", "t1", 5.0, 1.0, 0.0, 10.0, None, 2.0, 0.5),
                                ("Liga MX", "2023-2024", "aaaaaaaa", "t2", 2.0, 1.0, 0.0, 5.0, None, 1.0, -1.0)],
                               "league string, season string, player_id string, team_id string, games_complete double, games_subs double, "
                               "unused_subs double, on_goals_for double, on_goals_against double, points_per_game double, plus_minus_wowy double")
    kp = spark.createDataFrame([], "league string, season string, player_id string, team_id string, " + ", ".join(f"{c} double" for c in panel.KEEPER_SUMS))
    r = panel.by_season(panel.with_extras(panel.clean(raw), pt, kp)).filter("player = 'Raúl Pérez'").first()
    assert r.on_goals_for == 15 and r.on_goals_against is None and r.gk_games is None
    assert r.points_per_game == pytest.approx((2 * 10 + 1 * 5) / 15)
    assert r.plus_minus_wowy == pytest.approx((0.5 * 700 - 350) / 1050)


def test_signal_is_stable_and_noise_is_not(spark):
    rng = np.random.default_rng(0)
    s = rng.normal(0, 1, 200)
    rows = [(str(i), y, 2000.0, float(s[i]), float(rng.normal())) for y in (2020, 2021) for i in range(200)]
    df = spark.createDataFrame(rows, "player_key string, season_start int, minutes double, signal double, noise double")
    assert league.stability(df, [], "signal").first().r == pytest.approx(1.0)
    assert abs(league.stability(df, [], "noise").first().r) < 0.2


def test_ladder_recovers_known_difficulties(spark):
    rng = np.random.default_rng(7)
    level = {"A": 10.0, "B": 0.0, "C": -10.0}
    rows = []
    for i in range(900):
        a, b = rng.choice(list(level), 2, replace=False)
        rows.append((str(i), 2020, a, b, 50.0, 50.0 + level[a] - level[b] + float(rng.normal(0, 3)), level[a] - level[b] + float(rng.normal(0, 3))))
    moves = spark.createDataFrame(rows, "player_key string, season_start int, league string, league_next string, pct_complete double, pct_complete_next double, residual double")
    out = {r.league: r.difficulty for r in league.ladder(moves, list(level)).collect()}
    assert sum(out.values()) == pytest.approx(0, abs=1e-6)
    assert all(abs(out[k] - v) < 3 for k, v in level.items())
    ends = {r.league: (r.low, r.high) for r in league.ladder_bootstrap(moves, list(level), 50).collect()}
    assert ends["A"][0] > ends["C"][1]


def test_weighted_diagram_against_the_circle(spark):
    sites = spark.createDataFrame([("g", 1, 0.45, 0.5, 1.0), ("g", 2, 0.75, 0.5, 2.0)], "g string, s int, x double, y double, w double")
    unit = ((0.0, 1.0), (0.0, 1.0))
    area = {r.s: r.area for r in spatial.areas(sites, spatial.owners(sites, ["g"], "s", "w", "multiplicative", 200, unit), ["g"], "s", 200).collect()}
    assert area[1] == pytest.approx(math.pi * 0.04, rel=0.01) and sum(area.values()) == pytest.approx(1)
    x, y, r = spark.range(1).select(*spatial.apollonius_circle(*[F.lit(v) for v in (0.45, 0.5, 1.0, 0.75, 0.5, 2.0)])).first()
    assert (round(x, 9), y, round(r, 9)) == (0.35, 0.5, 0.2)
    same = sites.withColumn("w", F.lit(3.0))
    a = spatial.owners(same, ["g"], "s", "w", "multiplicative", 40, unit)
    assert a.exceptAll(spatial.owners(same, ["g"], "s", None, "plain", 40, unit)).count() == 0
    assert spatial.rejected_weights(sites.withColumn("w", F.lit(0.0)), "multiplicative", "w").count() == 2
    for wrong in (0.0, -1.0, None, float("nan")):
        with pytest.raises(Exception, match="weights must be positive"):
            spatial.owners(sites.withColumn("w", F.lit(wrong).cast("double")), ["g"], "s", "w").count()
    with pytest.raises(ValueError):
        spatial.owners(sites, ["g"], "s", None, "additive")


@pytest.mark.parametrize("mode", spatial.MODES)
@pytest.mark.parametrize("cells", [7, 45])
def test_diagram_equals_all_sites_against_all_cells(spark, mode, cells):
    """Pruned tiles against a plain pass: ids of text, a null group, copies of a site, sites outside and on cell centres."""
    rng = np.random.default_rng(cells)
    rows = [(g, f"s{i:02d}", float(rng.uniform(-1, 3)), float(rng.uniform(-0.5, 1.5)), float(rng.uniform(0.2, 2)) if mode != "additive" else float(rng.uniform(-0.3, 0.3)))
            for g in ("a", None, "b") for i in range(rng.integers(1, 25))]
    rows += [("b", "t1", 1.0, 0.5, 0.5), ("b", "t0", 1.0, 0.5, 0.5), ("c", "only", 0.3, 0.3, 0.2), ("d", "nowhere", None, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "g string, s string, x double, y double, w double")
    got = {(r.g, r.cell): r for r in spatial.owners(df, ["g"], "s", "w", mode, cells, ((0.0, 2.0), (0.0, 1.0)), True).collect()}
    want = {}
    for g in ("a", None, "b", "c"):
        for cell in range(cells * cells):
            cx, cy = (cell % cells + 0.5) * 2 / cells, (cell // cells + 0.5) / cells
            best = []
            for h, s, x, y, w in rows:
                if h == g and x is not None:
                    d = math.hypot(cx - x, cy - y)
                    best.append((math.floor((d / w if mode == "multiplicative" else d - w if mode == "additive" else d) * 1e9 + 0.5), s))
            want[g, cell] = min(best)[1]
    assert len(got) == len(want)
    assert all(got[k].s == v for k, v in want.items())
    for (g, cell), r in got.items():
        assert r.left == (want[g, cell - 1] if cell % cells else None) and r.lower == want.get((g, cell - cells))


def test_weights_scale_and_empty_sites(spark):
    rng = np.random.default_rng(3)
    rows = [("g", i, float(rng.random()), float(rng.random()), float(rng.uniform(50, 250))) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, s int, x double, y double, w double")
    unit = ((0.0, 1.0), (0.0, 1.0))
    a = spatial.owners(df, ["g"], "s", "w", cells=60, bounds=unit)
    assert a.exceptAll(spatial.owners(df.withColumn("w", F.col("w") * 37.5), ["g"], "s", "w", cells=60, bounds=unit)).count() == 0
    assert spatial.areas(df, a, ["g"], "s", 60).agg(F.sum("area")).first()[0] == pytest.approx(1)
    assert spatial.owners(df.limit(0), ["g"], "s", "w").count() == 0


def test_other_mode_is_refused(spark):
    sites = spark.createDataFrame([("g", 1, 0.45, 0.5, 1.0)], "g string, s int, x double, y double, w double")
    with pytest.raises(ValueError):
        spatial.owners(sites, ["g"], "s", "w", "other")


def test_success_rules_and_elevens(spark):
    e = spark.createDataFrame(
        [("Starting XI", None, None, (442, [((1,),)])), ("Pass", None, [40.0, 20.0], None), ("Pass", "Out", [40.0, 20.0], None)],
        "type string, pass_outcome string, location array<double>, tactics struct<formation:int,lineup:array<struct<player:struct<id:int>>>>")
    e = e.withColumns({"match_id": F.lit(1), "team": F.lit("A"), "player": F.lit("p"), "player_id": F.lit(1), "minute": F.lit(3), "position": F.lit("Center Back")})
    p = spatial.mean_positions(spatial.with_coordinates(e), 1).first()
    assert (p.actions, p.success_pct, p.x) == (2, 50.0, 40.0)
    xi = spatial.starting_elevens(e).first()
    assert (xi.formation, xi.player_id) == ("442", 1)


def test_minutes_are_added_per_stint(spark):
    s = spark.createDataFrame([(1, "A", 7, 0, "00:00", "30:00", "Starting XI", "Player Off"), (1, "A", 7, 1, "40:00", None, "Player On", "Final Whistle"),
                               (1, "A", 8, 0, "84:10", None, "Substitution - On", "Final Whistle")],
                              "match_id int, team string, player_id int, n int, `from` string, `to` string, start_reason string, end_reason string")
    out = {r.player_id: r for r in spatial.participation(s).collect()}
    assert out[7].minutes == 80.0 and out[7].state == "starter_full" and out[8].state == "substitute"


def test_kickoff_rules(spark):
    now = F.lit("2026-10-10 11:31:00").cast("timestamp")
    rows = [("2026-10-10", "12:30"), ("2026-10-10", "15:00"), ("2026-10-09", None), ("2026-10-10", None)]
    df = spark.createDataFrame(rows, "d string, t string").withColumn("d", F.col("d").cast("date"))
    assert [r[0] for r in df.select(tracking.has_started("d", "t", now, "Europe/London")).collect()] == [True, False, True, False]
    near = df.select(tracking.within_horizon(F.date_add("d", 5), now).alias("a"), tracking.within_horizon(F.date_add("d", 7), now).alias("b")).first()
    assert near.a and not near.b


def test_second_leg_swaps_teams_and_score(spark):
    t = "{{#invoke:Sports series|main\n|[[Wiliete SC|Wiliete]]|ANG|5–0 {{pso|4–3}}|[[Foresters]]|SEY|4–0|1–0\n|[[A]]|X|agg|[[B]]|Y|10 May|{{x|y}}\n}}"
    legs = articles.knockout_legs(spark.createDataFrame([("t", t)], "title string, text string"))
    got = [(r.home, r.away, r.hg, r.ag) for r in legs.orderBy("line_no", "leg").collect()]
    assert got == [("Wiliete", "Foresters", 4, 0), ("Foresters", "Wiliete", 0, 1), ("A", "B", None, None), ("B", "A", None, None)]


def test_alignment_by_content_then_position(spark):
    rows = spark.createDataFrame([(0, "a", "10"), (1, "b", "11"), (2, "c", "12"), (3, "x", "99")], "pos int, player string, games string")
    page = spark.createDataFrame([(0, "a", "10", "i0"), (1, "bb", "11", "i1"), (2, "c", "12", "i2"), (3, "y", "98", "i3")],
                                 "pos int, player string, games string, id string")
    out = {r.pos: (r.id, r.matched_by) for r in reshape.align_by_content(rows, page, ["player", "games"], "pos", ["games"], ["id"]).collect()}
    assert out == {0: ("i0", "content"), 1: ("i1", "position"), 2: ("i2", "content"), 3: (None, "none")}


def test_round_robin_format(spark):
    teams = "ABCD"
    pairs = [(h, a) for h in teams for a in teams if h < a]
    df = spark.createDataFrame([(i, "L", h, a, 1, 0, True) for i, (h, a) in enumerate(pairs)], "match_id int, k string, home string, away string, hg int, ag int, played boolean")
    assert competition.format_check(df, ["k"], 4, 3).first().teams == 4
    broken = df.withColumn("away", F.when(F.col("match_id") == 0, F.col("home")).otherwise(F.col("away")))
    assert "against_itself" in competition.format_check(broken, ["k"], 4, 3).first().failed_rules


@pytest.mark.parametrize("kind,sel,line,hg,ag,want", [
    ("1x2", "Local", None, 2, 1, "gano"), ("doble_oportunidad", "X2", None, 2, 1, "perdio"), ("over_under_goles", "over", 3.0, 2, 1, "push"),
    ("ambos_anotan", "no", None, 2, 0, "gano"), ("handicap", "Visitante", 1.5, 2, 1, "gano"), ("handicap", "Local", 1.0, 2, 1, "no calificable"),
    ("marcador_exacto", "2 - 1", None, 2, 1, "gano"), ("otro", "x", None, 2, 1, "no calificable"), ("1x2", "Local", None, None, None, "pendiente")])
def test_settlement(spark, kind, sel, line, hg, ag, want):
    df = spark.createDataFrame([(kind, sel, line, hg, ag, 5, 9)], "kind string, selection string, line double, hg int, ag int, cards int, corners int")
    assert bets.settle_legs(df).first().state == want


def test_text_rules(spark):
    df = spark.createDataFrame([("+150", "Édgar Méndez", "2024-05-03"), ("5/2", "Ñu", "3–1")], "o string, n string, s string")
    r = df.select(text.decimal_odds("o").alias("o"), text.slug("n").alias("n"), *[c.alias(x) for c, x in zip(text.strict_score("s"), "ab")]).collect()
    assert (r[0].o, r[0].n, r[0].a) == (2.5, "edgar-mendez", None)
    assert (r[1].o, r[1].a, r[1].b) == (3.5, 3, 1)


def test_gates(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2), (0.5, 0.3, 0.9)], "p_home double, p_draw double, p_away double")
    assert sinks.publish_gate(df, 10).count() == 2
    with pytest.raises(sinks.GateError):
        sinks.replace_gate(df, spark.range(5), ["p_home"])
    with pytest.raises(sinks.GateError):
        sinks.replace_gate(df, None, ["missing"])
    with pytest.raises(ValueError):
        documented(df, {"p_home": "probability of a home win"})


def test_documents_turn_nan_into_null(spark):
    df = spark.createDataFrame([("k", 1, float("nan"))], "k string, i int, v double")
    assert sinks.documents(df, "k", ["i"], ["i", "v"]).first().document == '{"i":1,"v":null}'


def test_levels_and_silhouettes_per_position(spark):
    rng = np.random.default_rng(3)
    rows = [(p, lv, float(10 * lv + rng.normal(0, 0.2)), float((5 if p == "DF" else -5) * lv + rng.normal(0, 0.2)))
            for p in ("DF", "FW", "GK") for lv in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "pos string, truth int, x double, y double")
    got = scouting.level_groups_by(df, "pos", ["DF", "FW"], ["x", "y"], "x", 3)
    assert got.count() == 240 and got.filter("level <> truth").count() == 0
    best = scouting.silhouette_by_k(df, "pos", ["DF", "FW"], ["x", "y"], [2, 3, 4]).toPandas()
    assert (best.loc[best.groupby("pos")["silhouette"].idxmax(), "k"] == 3).all()


def test_folders_of_documents_are_listed_a_group_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FOLDERS", 10)
    df = spark.range(300).selectExpr("concat('L', id % 60, '|', id % 2) AS key", "id AS i")
    groups = sinks.write_documents(sinks.documents(df, "key", ["i"], ["i"]), "key", f"{tmp_path}/d")
    folders = {n: len(list((tmp_path / "d" / f"group={n}").iterdir())) for n in groups}
    assert len(groups) > 3 and sum(folders.values()) == 60 and max(folders.values()) < 25
    back = sinks.read_documents(spark, f"{tmp_path}/d", groups, "i bigint, key string")
    assert sorted((r.key, r.i) for r in back.collect()) == sorted((r.key, r.i) for r in df.collect())
    empty = sinks.write_documents(sinks.documents(df.limit(0), "key", ["i"], ["i"]), "key", f"{tmp_path}/e")
    assert empty == [] and sinks.read_documents(spark, f"{tmp_path}/e", empty, "i bigint, key string").count() == 0
