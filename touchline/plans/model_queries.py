"""Queries with fitted models, similarity and level groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.numeric import r6
from touchline.functions.probability import ln_gamma
from touchline.operators import evaluate, inference, models, profiles, ranking, scouting
from touchline.plans.match_queries import FORECAST, evaluated, matches
from touchline.plans.panel_queries import SCORED, scored
from touchline.plans.registry import query
from touchline.plans.views import ctes, table, view
from touchline.session import settle, stored


def features(spark, sf):
    return profiles.match_profiles(matches(spark, sf), 10, 3)


def known(spark, sf):
    return features(spark, sf).filter("played").dropna(subset=models.GOAL_COLUMNS)


def trained(spark, sf):
    return settle(known(spark, sf))


@query("poisson_glm")
def poisson_glm(spark, sf):
    """Fitted expected goals per season against what was scored."""
    t = trained(spark, sf)
    m = models.GoalModel().fit(t)
    return m.expected(t).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("lam")).alias("lam"), r6(F.avg("hg")).alias("home_goals"),
        r6(F.avg("mu")).alias("mu"), r6(F.avg("ag")).alias("away_goals"))


@query("walk_forward")
def walk_forward(spark, sf):
    """Out-of-sample log-loss and RPS of the fitted model by season."""
    out = models.walk_forward(features(spark, sf).filter("played"), models.GOAL_COLUMNS)
    s = evaluate.with_scores(out.withColumn("actual", evaluate.outcome()), "p")
    return s.groupBy("season").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("logloss")).alias("logloss"),
                                   r6(F.avg("rps")).alias("rps"), r6(F.avg("hit")).alias("hit_rate"))


@query("future_forecasts")
def future_forecasts(spark, sf):
    """Final model on all history, applied to unplayed fixtures; rows without a profile are marked."""
    f = settle(features(spark, sf))
    m = models.GoalModel().fit(f.filter("played").dropna(subset=models.GOAL_COLUMNS))
    todo = f.filter("NOT played")
    done = m.predict(todo).withColumn("no_profile", F.lit(False))
    gone = todo.join(done.select("match_id"), "match_id", "left_anti").withColumn("no_profile", F.lit(True))
    both = ranking.union_all([done, gone])
    return both.select("match_id", "home", "away", "no_profile", r6("p_home").alias("p_home"), r6("p_draw").alias("p_draw"),
                       r6("p_away").alias("p_away"), F.when(~F.col("no_profile"), evaluate.pick("p")).alias("pick"))


@query("stacking")
def stacking(spark, sf):
    return models.stacking(evaluated(spark, sf)).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(c) for c in ("ll_market", "ll_alone", "ll_both")])


_RATIOS = {"H": "ln(greatest(p_home, 1e-12) / greatest(p_draw, 1e-12))", "A": "ln(greatest(p_away, 1e-12) / greatest(p_draw, 1e-12))"}


@query("recalibration_by_season")
def recalibration_by_season(spark, sf):
    """Each season's forecasts as they are and recalibrated by what earlier seasons showed: log-loss and RPS."""
    e = settle(evaluated(spark, sf))
    fits = models.fit_platt(models.platt_rows(e, "p"))
    s = evaluate.with_scores(evaluate.with_scores(models.recalibrated(e, fits, "p"), "p"), "r", suffix="_recalibrated")
    return s.groupBy("season").agg(F.count(F.lit(1)).alias("n"), *[
        r6(F.avg(f"{k}{w}")).alias(f"{k}{w}") for k in ("logloss", "rps") for w in ("", "_recalibrated")])


@query("recalibration_scores", f"""WITH {FORECAST}, x AS (SELECT season, actual, 1.0::double AS one, {_RATIOS['H']} AS lh, {_RATIOS['A']} AS la FROM ev),
r AS (SELECT f.season AS fitted_for, x.* FROM x JOIN (SELECT DISTINCT season FROM x) f ON f.season > x.season),
k AS (SELECT fitted_for FROM r GROUP BY fitted_for HAVING count(*) >= {models.MIN_TRAINING}),
s AS ({' UNION ALL '.join(f"SELECT fitted_for, '{c}' AS outcome, '{n}' AS name, sum(case when actual = '{c}' then {n} else 0 end) AS total FROM r WHERE fitted_for IN (SELECT fitted_for FROM k) GROUP BY ALL" for c in ('H', 'A') for n in ('one', 'lh', 'la'))})
SELECT fitted_for, outcome, name, round(total, 3) AS observed, round(total, 3) AS expected FROM s""")
def recalibration_scores(spark, sf):
    """The score equations of every season's recalibration: observed and expected sums of each class and term."""
    rows = settle(models.platt_rows(settle(evaluated(spark, sf)), "p").withColumn("one", F.lit(1.0)))
    p = models.platt_probabilities(rows, models.fit_platt(rows))
    terms = F.array(*[F.struct(F.lit(c).alias("outcome"), F.lit(n).alias("name"), F.when(F.col("y") == c, F.col(n)).otherwise(0.0).alias("o"),
                               (F.col(q) * F.col(n)).alias("e")) for c, q in (("H", "ph"), ("A", "pa")) for n in ("one", "lh", "la")])
    return p.select("fitted_for", F.inline(terms)).groupBy("fitted_for", "outcome", "name").agg(
        F.round(F.sum("o"), 3).alias("observed"), F.round(F.sum("e"), 3).alias("expected"))


@query("multinomial_logit")
def multinomial_logit(spark, sf):
    y = F.expr("case when hg = ag then 0 when hg > ag then 1 else 2 end")
    t = settle(trained(spark, sf).withColumn("y", y))
    fit = models.fit_multinomial(t, models.GOAL_COLUMNS, "y")
    p = models.class_probabilities(fit, t, models.GOAL_COLUMNS, ["q_draw", "q_home", "q_away"]).withColumn(
        "actual", evaluate.outcome())
    return evaluate.with_scores(p, "q").groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("logloss")).alias("logloss"), r6(F.avg("hit")).alias("hit_rate"))


@query("negative_binomial")
def negative_binomial(spark, sf):
    cols = ["home_cards", "away_cards"]
    t = trained(spark, sf).withColumn("cards", F.expr("hy + hr + ay + ar"))
    beta = models.fit_negative_binomial(t, cols, "cards")
    rows = t.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cards")).alias("mean"), r6(F.var_samp("cards")).alias("variance"))
    return rows.withColumns({n: r6(F.lit(b)) for n, b in zip(["intercept", *cols], beta)})


#: Cards explained by nothing, fouls, fouls and teams, fouls and the referee, or all three.
CARD_MODELS = {
    "null": ([], []), "fouls": (["fouls"], []), "teams": (["fouls"], ["home", "away"]), "referee": (["fouls"], ["referee"]),
    "all": (["fouls"], ["home", "away", "referee"])}
CARD_TESTS = [("null", "fouls"), ("fouls", "teams"), ("fouls", "referee"), ("referee", "all")]


def nested_cards(spark, sf):
    """Rows and fits of the five models of cards, league by league. The rows, five for a match, are made again where they are read."""
    cards = view(spark, sf, "v_match").filter("played").selectExpr(
        "league", "home", "away", "referee", "hf + af AS fouls", "hy + hr + ay + ar AS cards")
    rows = models.design_rows(cards, ["league"], "cards", CARD_MODELS)
    return rows, models.fit_sparse_poisson(rows, ["league", "model"])


@query("nested_card_models")
def nested_card_models(spark, sf):
    """Five nested models of a league's cards by AIC and pseudo R2."""
    out = models.fit_table(*nested_cards(spark, sf), ["league", "model"])
    return out.select("league", "model", "n", "parameters", *[r6(c).alias(c) for c in ("log_likelihood", "aic", "pseudo_r2")])


@query("nested_card_tests")
def nested_card_tests(spark, sf):
    """Likelihood-ratio tests between them."""
    table_ = settle(models.fit_table(*nested_cards(spark, sf), ["league", "model"]))
    out = models.likelihood_ratio_tests(table_, ["league"], CARD_TESTS)
    return out.select("league", "small", "large", "dof", r6("lr").alias("lr"), r6("p_value").alias("p_value"))


_CARD_NAMES = {"const": "1", "fouls": "fouls", "home": "home", "away": "away", "referee": "referee"}
_CARD_SCORES = " UNION ALL ".join(
    f"SELECT league, '{m}' AS model, {f"'{n}'" if n in ('const', 'fouls') else f"'{n}=' || {n}"} AS name, sum(cards * {'fouls' if n == 'fouls' else 1}) AS total FROM c GROUP BY ALL"
    for m, (numeric, factors) in CARD_MODELS.items() for n in ("const", *numeric, *factors))


@query("nested_card_scores", f"""WITH {ctes('v_match')}, c AS (SELECT league, home, away, referee, hf + af AS fouls, hy + hr + ay + ar AS cards FROM v_match WHERE played), s AS ({_CARD_SCORES})
SELECT league, model, name, round(total::double, 4) AS observed, round(total::double, 4) AS expected FROM s""")
def nested_card_scores(spark, sf):
    """The score equations of all these fits: what each team, referee and foul count explains adds up to what was observed."""
    out = models.score_sums(*nested_cards(spark, sf), ["league", "model"])
    return out.select("league", "model", "name", F.round("observed", 4).alias("observed"), F.round("expected", 4).alias("expected"))


#: A match's cards before it is played: the teams' averages, the referee's, or both.
CARD_FORECASTS = {"teams": (["home_cards", "away_cards"], []), "referee": (["strictness"], []),
                  "both": (["home_cards", "away_cards", "strictness"], [])}


def card_forecasts(spark, sf):
    """(training rows, fits, forecast rows) of each league, season and model; a fit saw earlier seasons only.

    Matches are written once with their few columns; the rows of models, and of the seasons they help to fit, are made where they are read.
    """
    strict = profiles.referee_strictness_as_of(matches(spark, sf), 100).select("match_id", "strictness")
    cards = known(spark, sf).select("match_id", "league", "season", "home_cards", "away_cards", F.expr("hy + hr + ay + ar").alias("total_cards"))
    t = settle(cards.join(strict, "match_id"))
    rows = models.design_rows(t, ["league", "season"], "total_cards", CARD_FORECASTS, ["match_id"])
    seasons = sorted(r.season for r in t.select("season").distinct().collect())
    past = models.later_seasons(rows, seasons, listed=True)
    fits = models.fit_sparse_poisson(past, ["league", "fitted_for", "model"], least=MIN_CARD_TRAINING)
    return past, fits, rows.withColumn("fitted_for", F.col("season"))


MIN_CARD_TRAINING = 50  # matches of a league before its cards are forecast


@query("card_forecast_ablation")
def card_forecast_ablation(spark, sf):
    """Out of sample, per season: log-loss of the cards forecast from teams, the referee or both, on the same matches."""
    past, fits, ahead = card_forecasts(spark, sf)
    out = models.sparse_mean(ahead, fits, ["league", "fitted_for", "model"])
    y, m = F.col("_y"), F.col("_mu")
    return out.groupBy("season", "model").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(m)).alias("expected"), r6(F.avg(y)).alias("observed"),
        r6(F.avg(m - y * F.ln(m) + ln_gamma(y + 1))).alias("logloss"), r6(F.avg(F.abs(y - m))).alias("mean_error"))


def _effects_sql(rounds: int = 8) -> str:
    """The fitting rounds written out: team effects a, then side effects b."""
    steps = ["b0 AS (SELECT DISTINCT side, 1.0::double AS b FROM c)"]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT league, team, sum(s) / sum(n * b) AS a FROM c JOIN b{k} USING (side) GROUP BY ALL)")
        steps.append(f"b{k + 1} AS (SELECT side, sum(s) / sum(n * a) AS b FROM c JOIN a{k} USING (league, team) GROUP BY side)")
    return ", ".join(steps)


@query("team_effects", f"""WITH {ctes('v_match')}, l AS (SELECT league, home AS team, 'H' AS side, hc AS v FROM v_match UNION ALL SELECT league, away, 'A', ac FROM v_match),
c AS (SELECT league, team, side, sum(v) AS s, count(*) AS n FROM l GROUP BY ALL), {_effects_sql()}
SELECT league, team, side, round(s / n, 6) AS observed, round(a * b, 6) AS expected, round(s / n - a * b, 6) AS residual FROM c JOIN a8 USING (league, team) JOIN b8 USING (side)""")
def team_effects(spark, sf):
    from touchline.operators.reshape import team_rows

    long = team_rows(view(spark, sf, "v_match"), ["league"], {"corners": ("hc", "ac")})
    out = models.team_effects(long, "corners", ["league", "team"], "side")
    return out.select("league", "team", "side", *[r6(c).alias(c) for c in ("observed", "expected", "residual")])


@query("ordinal_tables", f"""WITH {ctes('v_match')}, b AS (SELECT match_id, hy + hr + ay + ar AS cards, hf + af AS fouls, hc + ac AS corners FROM v_match),
r AS (SELECT {', '.join(f'row_number() OVER (ORDER BY {c}, match_id) AS r_{c}' for c in ('cards', 'fouls', 'corners'))}, count(*) OVER () AS n FROM b),
t AS (SELECT {', '.join(f'case when r_{c} <= 1 + (n - 1) / 3.0 then 0 when r_{c} <= 1 + 2 * (n - 1) / 3.0 then 1 else 2 end AS {c}' for c in ('cards', 'fouls', 'corners'))} FROM r)
SELECT 'cards~fouls' AS pair, cards AS x, fouls AS y, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'cards~corners', cards, corners, count(*) FROM t GROUP BY ALL""")
def ordinal_tables(spark, sf):
    return inference.ordinal_tables(_terciles(spark, sf), [("cards", "fouls"), ("cards", "corners")])


def _terciles(spark, sf):
    b = view(spark, sf, "v_match").selectExpr("match_id", "hy + hr + ay + ar AS cards", "hf + af AS fouls", "hc + ac AS corners")
    long = b.unpivot(["match_id"], ["cards", "fouls", "corners"], "metric", "value")
    levels = ranking.linear_edges_tercile(long, ["metric"], "value", "match_id", "level")
    return levels.groupBy("match_id").pivot("metric", ["cards", "fouls", "corners"]).agg(F.max("level"))


@query("polychoric")
def polychoric(spark, sf):
    tables = settle(inference.ordinal_tables(_terciles(spark, sf), [("cards", "fouls"), ("cards", "corners")]))
    return inference.polychoric(tables).withColumn("r", r6("r"))


_COLS = ["hf", "af", "hc", "ac", "hst", "ast"]


@query("correlation_matrix", f"""WITH {ctes('v_match')} """ + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM v_match"
    for i, a in enumerate(_COLS) for b in _COLS[i + 1:]))
def correlation_matrix(spark, sf):
    return ranking.correlation_pairs(view(spark, sf, "v_match"), _COLS).withColumn("r", r6("r"))


@query("similar_vectors_topk", """WITH t AS (SELECT label, min(vec_id) AS target FROM embeddings GROUP BY label), tv AS (SELECT t.label, target, embedding AS tv FROM t JOIN embeddings e ON e.vec_id = t.target),
s AS (SELECT e.label, target, vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * tv[i]::double)) / (sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))) *
  sqrt(list_sum(list_transform(tv, lambda v: v::double * v::double)))), 9) AS similarity FROM embeddings e JOIN tv USING (label) WHERE vec_id <> target)
SELECT label, target, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY label, target ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def similar_vectors_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    targets = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("_b")).select("label", "_b.*")
    return scouting.most_similar(e, targets, ["label"], "vec_id", "embedding", 5).withColumn("similarity", r6("similarity"))


OUTFIELD = ["DF", "MF", "FW"]
_SIM = ["goals_pens_per90", "assists_per90", "minutes_share"]


@query("similar_players", f"""WITH {SCORED}, z0 AS (SELECT player_key || '|' || league || '|' || season AS id, main_position, minutes, goals_pens_per90, assists / (minutes / 90) AS assists_per90, least(1, minutes / (league_games * 90)) AS minutes_share FROM sc WHERE minutes >= 600),
z AS (SELECT id, main_position, minutes, {', '.join(f'coalesce(({c} - avg({c}) OVER (PARTITION BY main_position)) / nullif(stddev_pop({c}) OVER (PARTITION BY main_position), 0), 0) AS z{i}' for i, c in enumerate(_SIM))} FROM z0),
t AS (SELECT main_position, id AS target, z0 AS t0, z1 AS t1, z2 AS t2 FROM z QUALIFY row_number() OVER (PARTITION BY main_position ORDER BY minutes DESC, id) = 1),
s AS (SELECT z.main_position, target, id, round((z0 * t0 + z1 * t1 + z2 * t2) / nullif(sqrt(z0 * z0 + z1 * z1 + z2 * z2) * sqrt(t0 * t0 + t1 * t1 + t2 * t2), 0), 9) AS similarity FROM z JOIN t USING (main_position) WHERE id <> target)
SELECT main_position, target, round(similarity, 5) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY main_position, target ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 8""")
def similar_players(spark, sf):
    d = scored(spark, sf).filter("minutes >= 600").select(
        F.concat_ws("|", "player_key", "league", "season").alias("id"), "main_position", "minutes", *_SIM)
    z = settle(scouting.standardised(d, ["main_position"], _SIM).withColumn("v", F.array(*[f"z_{c}" for c in _SIM])))
    targets = z.groupBy("main_position").agg(F.min_by(F.struct("id", "v"), F.struct(-F.col("minutes"), "id")).alias("_b")).select("main_position", "_b.*")
    return scouting.most_similar(z, targets, ["main_position"], "id", "v", 8).select(
        "main_position", "target", F.round("similarity", 5).alias("similarity"), "rank")


def _profiles(spark, sf, *keep: str):
    """The compared rates of players with enough minutes, standardised by position: written once with the columns asked for."""
    d = scored(spark, sf).filter("minutes >= 600 AND goals_pens_per90 IS NOT NULL")
    return scouting.standardised(stored(d.selectExpr("main_position", *_SIM, *keep)), ["main_position"], _SIM).drop(*_SIM)


_OUTPUT = "90 * (goals + assists) / minutes AS goals_assists_per90"


def _levels(z, seed=42):
    return scouting.level_groups_by(z, "main_position", OUTFIELD, [f"z_{c}" for c in _SIM], "goals_assists_per90", 3, seed)


@query("level_clusters")
def level_clusters(spark, sf):
    return scouting.level_mix(_levels(_profiles(spark, sf, "league", _OUTPUT)), "league")


@query("level_drift")
def level_drift(spark, sf):
    z = _profiles(spark, sf, "concat_ws('|', player_key, league, season) AS id", _OUTPUT)
    return scouting.label_drift(_levels(z).select("id", "level"), _levels(z, 7).select("id", "level"), "id")


@query("silhouette")
def silhouette(spark, sf):
    return scouting.silhouette_by_k(_profiles(spark, sf), "main_position", OUTFIELD, [f"z_{c}" for c in _SIM], [2, 3, 4, 5, 6])


@query("pca_loadings")
def pca_loadings(spark, sf):
    cols = ["games", "minutes", "goals", "assists", "cards_yellow", "pts_total"]
    d = scouting.standardised(scored(spark, sf).withColumn("_all", F.lit(0)), ["_all"], cols)
    return scouting.principal_components(d, [f"z_{c}" for c in cols], 3)


