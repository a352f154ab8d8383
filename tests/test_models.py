"""Fits of many groups at once: against plain Newton steps, by their score equations, and in hard cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import models


def plain_poisson(x, y, steps=60):
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(max(y.mean(), 1e-6))
    for _ in range(steps):
        mu = np.exp(x @ beta)
        beta += np.linalg.pinv(x.T @ (mu[:, None] * x), hermitian=True) @ (x.T @ (y - mu))
    return np.exp(x @ beta)


def unbalanced(seed=1, n=400):
    """Two leagues; teams meet unevenly, one referee has a single match."""
    r = np.random.default_rng(seed)
    rows = []
    for league in ("a", "b"):
        strength = r.normal(0, 0.4, 6)
        for i in range(n if league == "a" else n // 4):
            h = int(r.choice(6, p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05]))
            a = int((h + 1 + r.integers(5)) % 6)
            ref = "once" if i == 0 else f"r{int(r.integers(3))}"
            fouls = int(r.integers(10, 30))
            y = 2 if ref == "once" else int(r.poisson(math.exp(0.3 + strength[h] - strength[a] / 2 + 0.03 * fouls)))
            rows.append((league, f"t{h}", f"t{a}", ref, fouls, y))
    return rows


KINDS = "league string, home string, away string, referee string, fouls int, cards int"
DESIGNS = {"fouls": (["fouls"], []), "teams": (["fouls"], ["home", "away"]), "all": (["fouls"], ["home", "away", "referee"])}


@pytest.fixture(scope="module")
def fitted(spark):
    rows = models.design_rows(spark.createDataFrame(unbalanced(), KINDS).coalesce(2), ["league"], "cards", DESIGNS)
    return rows, models.fit_sparse_poisson(rows, ["league", "model"])


def test_means_equal_plain_newton(spark, fitted):
    data = unbalanced()
    got = {(r.league, r.model): r for r in models.fit_table(*fitted, ["league", "model"]).collect()}
    assert len(got) == 6
    for league in ("a", "b"):
        mine = [r for r in data if r[0] == league]
        y = np.array([r[5] for r in mine], float)
        for model, (numeric, factors) in DESIGNS.items():
            cols = [np.ones(len(mine))] + [np.array([r[4] for r in mine], float) for _ in numeric]
            for f in factors:
                at = {"home": 1, "away": 2, "referee": 3}[f]
                cols += [np.array([r[at] == v for r in mine], float) for v in sorted({r[at] for r in mine})]
            x = np.stack(cols, axis=1)
            mu = plain_poisson(x, y)
            ll = sum(v * math.log(m) - m - math.lgamma(v + 1) for v, m in zip(y, mu))
            g = got[league, model]
            assert g.n == len(mine)
            assert g.parameters == np.linalg.matrix_rank(x)
            assert g.log_likelihood == pytest.approx(ll, abs=1e-4)
            assert g.aic == pytest.approx(2 * g.parameters - 2 * ll, abs=1e-3)


def test_score_equations(spark, fitted):
    found = models.score_sums(*fitted, ["league", "model"]).collect()
    assert len(found) > 60
    assert all(abs(r.observed - r.expected) < 1e-3 for r in found)


def test_likelihood_ratio_tests(spark, fitted):
    table = models.fit_table(*fitted, ["league", "model"])
    out = models.likelihood_ratio_tests(table, ["league"], [("fouls", "teams"), ("teams", "all")]).collect()
    assert len(out) == 4
    by = {(r.league, r.small): r for r in out}
    assert by["a", "fouls"].dof == 10 and by["a", "fouls"].p_value < 1e-6
    assert by["a", "teams"].dof in (2, 3) and by["a", "teams"].p_value > 1e-4


def test_unseen_levels_missing_values_and_no_rows(spark, fitted):
    _, fits = fitted
    new = spark.createDataFrame([("a", "t0", "new", "r0", 20, 1), ("a", "t0", "t1", None, 20, 1), ("zzz", "t0", "t1", "r0", 20, 1)], KINDS)
    rows = models.design_rows(new, ["league"], "cards", {"teams": DESIGNS["teams"], "all": DESIGNS["all"]})
    assert rows.count() == 4  # a row that lacks a referee is left out of all models: they are compared on the same rows
    means = models.sparse_mean(rows, fits, ["league", "model"]).collect()
    assert {r.league for r in means} == {"a"} and all(r._mu > 0 for r in means)
    none = models.fit_sparse_poisson(models.design_rows(new.limit(0), ["league"], "cards", DESIGNS), ["league", "model"])
    assert none.count() == 0


def test_a_level_without_any_count(spark):
    """Its expected value falls towards zero; the others are as if it weren't there."""
    data = [("a", "t0", 2), ("a", "t0", 4), ("a", "t1", 5), ("a", "t2", 0), ("a", "t2", 0)]
    rows = models.design_rows(spark.createDataFrame(data, "league string, home string, cards int"), ["league"], "cards", {"m": ([], ["home"])})
    fits = models.fit_sparse_poisson(rows, ["league", "model"], tol=0.01)
    got = {r.name: r for r in models.score_sums(rows, fits, ["league", "model"]).collect()}
    assert got["home=t0"].expected == pytest.approx(6, abs=0.02) and got["home=t1"].expected == pytest.approx(5, abs=0.02)
    assert 0 < got["home=t2"].expected < 0.02
    with pytest.raises(RuntimeError):
        models.fit_sparse_poisson(rows, ["league", "model"], steps=1)


def test_training_rows_of_later_seasons(spark):
    rows = spark.createDataFrame([(2000, 1), (2001, 2), (2002, 3)], "season long, v int")
    got = models.later_seasons(rows, [2000, 2001, 2002]).orderBy("season", "fitted_for").collect()
    assert [(r.season, r.fitted_for) for r in got] == [(2000, 2001), (2000, 2002), (2001, 2002)]
    assert models.later_seasons(rows, [2000]).filter(F.col("season") >= F.col("fitted_for")).count() == 0


def miscalibrated(seed=4, n=1500):
    """Forecasts far too sure of themselves, in three seasons, the last of which nothing may learn from."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        eta = np.array([0.0, r.normal(0.3, 0.6), r.normal(0, 0.6)])
        p = np.exp(eta) / np.exp(eta).sum()
        q = np.exp(2.5 * eta + np.array([0.5, 0, 0]))
        q /= q.sum()
        rows.append((i, 2000 + i % 3, "DHA"[r.choice(3, p=p)], *map(float, q)))
    return rows


def test_recalibration_sees_the_past_only(spark):
    from touchline.operators import evaluate

    kinds = "match_id int, season int, actual string, p_draw double, p_home double, p_away double"
    df = spark.createDataFrame(miscalibrated(), kinds)
    fits = models.fit_platt(models.platt_rows(df, "p"))
    theta = {r.fitted_for: r.theta for r in fits.collect()}
    assert set(theta) == {2001, 2002}
    changed = df.withColumn("actual", F.when(F.col("season") == 2002, "D").otherwise(F.col("actual")))
    again = {r.fitted_for: r.theta for r in models.fit_platt(models.platt_rows(changed, "p")).collect()}
    assert all(np.allclose(again[k], theta[k]) for k in theta)
    out = evaluate.with_scores(evaluate.with_scores(models.recalibrated(df, fits, "p"), "p"), "r", suffix="_r")
    scored = {r.season: r for r in out.groupBy("season").agg(F.avg("logloss").alias("a"), F.avg("logloss_r").alias("b"), F.count("match_id").alias("n")).collect()}
    assert set(scored) == {2001, 2002} and all(r.n == 500 and r.b < r.a - 0.02 for r in scored.values())
    sums = models.platt_probabilities(models.platt_rows(df, "p"), fits).groupBy("fitted_for").agg(
        F.sum(F.col("ph") - (F.col("y") == "H").cast("int")).alias("h"), F.sum(F.col("lh") * (F.col("pa") - (F.col("y") == "A").cast("int"))).alias("a")).collect()
    assert all(abs(r.h) < 1e-3 and abs(r.a) < 1e-3 for r in sums)
    assert models.fit_platt(models.platt_rows(df, "p"), min_training=10_000).count() == 0


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_steps_of_small_fits_cost_no_jobs(spark, fitted):
    rows, keys = fitted[0], ["league", "model"]
    rough, few = jobs_of(spark, "rough", lambda: models.fit_sparse_poisson(rows, keys, tol=50.0))
    fine, many = jobs_of(spark, "fine", lambda: models.fit_sparse_poisson(rows, keys, tol=1e-9))
    assert fine.agg(F.max("left")).first()[0] < 1e-9 < rough.agg(F.max("left")).first()[0]
    assert few == many


def test_large_fits_spread_over_tasks_are_the_same(spark, fitted, monkeypatch):
    rows, keys = fitted[0], ["league", "model"]
    want = {(r.league, r.model): r for r in models.fit_table(*fitted, keys).collect()}
    monkeypatch.setattr(models, "WHOLE_FIT", 150)  # the second league has 100 rows
    monkeypatch.setattr(models, "FIT_BATCH", 50)
    got = {(r.league, r.model): r for r in models.fit_table(rows, models.fit_sparse_poisson(rows, keys), keys).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k, r in got.items():
        assert r.parameters == want[k].parameters and r.log_likelihood == pytest.approx(want[k].log_likelihood, abs=1e-5)


@pytest.mark.parametrize("whole", [200_000, 200])
def test_rows_listed_for_seasons_fit_like_a_row_for_each(spark, monkeypatch, whole):
    """And seasons with fewer than `least` rows have no fit."""
    monkeypatch.setattr(models, "WHOLE_FIT", whole)
    monkeypatch.setattr(models, "FIT_BATCH", 60)
    r = np.random.default_rng(2)
    data = [(lg, 2000 + int(i % 4), float(r.normal()), int(r.poisson(2))) for lg in "abc" for i in range(40 if lg == "c" else 120)]
    df = spark.createDataFrame(data, "league string, season long, v double, cards int")
    rows = models.design_rows(df, ["league", "season"], "cards", {"v": (["v"], []), "null": ([], [])})
    keys = ["league", "fitted_for", "model"]
    seasons = [2000, 2001, 2002, 2003]
    got = {tuple(f[:3]): f.beta for f in models.fit_sparse_poisson(models.later_seasons(rows, seasons, listed=True), keys, least=25).collect()}
    each = models.later_seasons(rows, seasons)
    want = {tuple(f[:3]): f.beta for f in models.fit_sparse_poisson(each, keys).collect()}
    sizes = {tuple(s[:3]): s.n for s in each.groupBy(*keys).agg(F.count("_y").alias("n")).collect()}
    assert set(got) == {k for k, n in sizes.items() if n >= 25} and len(got) == 14
    for k, beta in got.items():
        assert beta == pytest.approx(want[k], abs=1e-6)
