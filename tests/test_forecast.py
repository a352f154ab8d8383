"""Score probabilities, evaluation, resampling and fitted models."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions.numeric import ratio
from touchline.functions.probability import (expected_floor, ln_gamma, normal_cdf, normal_quantile, poisson_cdf, poisson_pmf,
                                             resample_copies, uniforms, with_uniform)
from touchline.operators import evaluate, inference, models, profiles, scoreline
from touchline.plans.match_queries import matches

SF = "/root/testdata/sf0.001"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_probability_functions(spark):
    r = one(spark, a=normal_cdf(F.lit(1.959963984540054)), b=normal_quantile(F.lit(0.975)), c=poisson_pmf(F.lit(3), F.lit(2.5)),
            d=poisson_cdf(F.lit(2.5), F.lit(1.2)), e=ln_gamma(F.lit(10.5)), f=expected_floor(F.lit(0.0), 3), g=expected_floor(F.lit(4.0), 1))
    assert r.a == pytest.approx(0.975, abs=1e-12)
    assert r.b == pytest.approx(1.959963984540054, abs=1e-7)
    assert r.c == pytest.approx(math.exp(-2.5) * 2.5 ** 3 / 6)
    assert r.d == pytest.approx(sum(math.exp(-1.2) * 1.2 ** k / math.factorial(k) for k in range(3)))
    assert r.e == pytest.approx(math.lgamma(10.5), abs=1e-10)
    assert (r.f, round(r.g, 9)) == (0.0, 4.0)


def brute(lam, mu, rho):
    p = lambda m, k: math.exp(-m) * m ** k / math.factorial(k)
    g = np.array([[p(lam, i) * p(mu, j) for j in range(11)] for i in range(11)])
    g[0, 0] *= 1 - lam * mu * rho
    g[0, 1] *= 1 + lam * rho
    g[1, 0] *= 1 + mu * rho
    g[1, 1] *= 1 - rho
    g = np.clip(g, 1e-12, None)
    return g / g.sum()


@pytest.mark.parametrize("lam,mu,rho", [(1.4, 1.1, 0.0), (1.4, 1.1, -0.1), (0.05, 4.0, 0.2), (2.0, 2.0, 0.1)])
def test_outcomes_and_grid_match_brute_force(spark, lam, mu, rho):
    df = spark.createDataFrame([(lam, mu)], "lam double, mu double")
    g = brute(lam, mu, rho)
    r = scoreline.outcome_probabilities(df, "lam", "mu", rho).first()
    assert r.p_draw == pytest.approx(np.trace(g), abs=1e-8)
    assert r.p_home == pytest.approx(np.tril(g, -1).sum(), abs=1e-8)
    if lam == mu:
        assert r.p_home == pytest.approx(r.p_away, abs=1e-9)
    q = df.withColumn("g", scoreline.score_grid("lam", "mu", rho)).select(
        scoreline.grid_sum("g", lambda i, j: i + j > 2.5).alias("over")).first()
    assert q.over == pytest.approx(sum(g[i, j] for i in range(11) for j in range(11) if i + j > 2.5), abs=1e-9)


def test_margin_methods_sum_to_one(spark):
    df = spark.createDataFrame([(1.8, 3.6, 4.5)], "h double, d double, a double")
    for f, p in ((scoreline.market_probabilities, "m"), (scoreline.shin_probabilities, "shin"), (scoreline.odds_ratio_probabilities, "oratio")):
        r = f(df, "h", "d", "a", p).first().asDict()
        assert sum(r[f"{p}_{k}"] for k in ("home", "draw", "away")) == pytest.approx(1.0, abs=1e-6)


def test_the_future_does_not_change_a_profile(spark):
    m = matches(spark, SF)
    cut = F.lit("1998-06-01").cast("date")
    changed = m.withColumn("hg", F.when(F.col("match_date") >= cut, 9).otherwise(F.col("hg")).cast("bigint"))
    cols = ["match_id", "home_goals_for", "away_goals_against"]
    a, b = (profiles.match_profiles(x, 5, 2).filter(F.col("match_date") < cut).select(*cols) for x in (m, changed))
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_scores_of_a_known_forecast(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2, "H")], "p_home double, p_draw double, p_away double, actual string")
    r = evaluate.with_scores(df, "p").first()
    assert r.rps == pytest.approx(0.5 * (0.25 + 0.04))
    assert r.brier == pytest.approx(0.25 + 0.09 + 0.04)
    assert r.logloss == pytest.approx(-math.log(0.5)) and r.hit == 1


def test_rho_is_found_near_a_fine_grid(spark):
    rng = np.random.default_rng(5)
    g = brute(1.3, 1.1, -0.15).ravel()
    draws = rng.choice(121, 20000, p=g)
    df = spark.createDataFrame(pd.DataFrame({"lam": 1.3, "mu": 1.1, "hg": draws // 11, "ag": draws % 11}))
    rho = scoreline.fit_rho(df, "lam", "mu", "hg", "ag")
    assert rho == pytest.approx(-0.15, abs=0.05)


def test_bootstrap_interval_has_the_right_width(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(2.0, 1.0, 2000)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "x": x, "n": 1}))
    r = inference.bootstrap(df, "id", ["x", "n"], {"m": F.col("x") / F.col("n")}, 400).first()
    half = 1.96 * x.std() / math.sqrt(2000)
    assert r.m_value == pytest.approx(x.mean())
    assert (r.m_high - r.m_low) / 2 == pytest.approx(half, rel=0.2)


def test_copies_average_to_one(spark):
    df = with_uniform(spark.range(20000).withColumn("r", F.col("id") % 7), "u", 3, "id", "r").orderBy("id").toPandas()
    assert np.array_equal(df["u"], uniforms(3, df["id"].to_numpy(), df["r"].to_numpy()))
    copies = resample_copies(df["u"].to_numpy())
    assert df["u"].mean() == pytest.approx(0.5, abs=0.01)
    assert copies.mean() == pytest.approx(1, abs=0.03) and copies.var() == pytest.approx(1, abs=0.06)


def test_draws_use_all_of_an_id(spark):
    from duckdb import sql

    from touchline.plans.sql_text import uniform_from

    far = 2**31 - 1
    ids = [5, 5 + far, 5 + 2 * far, -5, far - 5, -2**63 + 1, 2**63 - 1]
    df = spark.createDataFrame([(i, r) for i in ids for r in range(3)], "id bigint, r int")
    got = with_uniform(df, "u", 3, "id", "r").toPandas()
    assert np.array_equal(got["u"], uniforms(3, got["id"].to_numpy(), got["r"].to_numpy(np.int64)))
    assert got["u"].between(0, 1, inclusive="left").all() and got["u"].nunique() == len(got)
    rows = ", ".join(f"({i}, {r})" for i, r in zip(got["id"], got["r"]))
    there = sql(f"SELECT u FROM {uniform_from(f'(SELECT * FROM (VALUES {rows}) AS t(id, r))', 'u', 3, 'id', 'r')}").fetchall()
    assert np.allclose(sorted(x[0] for x in there), sorted(got["u"]), rtol=0, atol=1e-12)


def test_chi_square_tails(spark):
    known = [(3.841458820694124, 1, 0.05), (10.827566170662733, 1, 0.001), (0.0, 1, 1.0), (5.991464547107979, 2, 0.05),
             (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (24.995790139728616, 15, 0.05), (0.0, 4, 1.0)]
    df = spark.createDataFrame(known, "x double, k int, p double").withColumn("q", inference.chi_square_tail("x", "k"))
    assert all(r.q == pytest.approx(r.p, abs=1e-9) for r in df.collect())


def test_poisson_beyond_sixty(spark):
    r = spark.range(1).select(poisson_cdf(F.lit(99.5), F.lit(100.0)).alias("p"), poisson_cdf(F.lit(-1), F.lit(2.0)).alias("q")).first()
    assert r.p == pytest.approx(0.486701, abs=1e-6) and r.q == 0


def test_team_effects_satisfy_their_margins(spark):
    rng = np.random.default_rng(8)
    rows = [(f"T{t}", s, int(rng.poisson((2 + t) * (1.5 if s == "H" else 0.8)))) for t in range(12) for s in "HA"
            for _ in range(int(rng.integers(3, 60) if s == "H" else rng.integers(40, 90)))]
    df = spark.createDataFrame(rows, "team string, side string, v int")
    fit = models.team_effects(df, "v", ["team"], "side", rounds=40).toPandas()
    n = pd.DataFrame(rows, columns=["team", "side", "v"]).groupby(["team", "side"]).size().rename("n").reset_index()
    m = fit.merge(n, on=["team", "side"])
    gap = (m["residual"] * m["n"])
    assert gap.groupby(m["team"]).sum().abs().max() < 1e-6
    assert gap.groupby(m["side"]).sum().abs().max() < 1e-6


def test_fisher_and_discovery_rate(spark):
    t = spark.createDataFrame([(1, 8, 2, 1, 5)], "k int, a bigint, b bigint, c bigint, d bigint")
    assert inference.fisher_exact(t, ["k"], "a", "b", "c", "d").first().p_value == pytest.approx(0.034965, abs=1e-6)
    p = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "p double")
    got = [r.adjusted for r in inference.adjust_false_discovery(p, "p").orderBy("p").collect()]
    assert got == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_null_spread_sees_chance_and_signal(spark):
    even = spark.createDataFrame([(i, 200, 90 + i % 5) for i in range(20)], "g bigint, n bigint, w bigint")
    wide = spark.createDataFrame([(i, 200, 40 + 6 * i) for i in range(20)], "g bigint, n bigint, w bigint")
    assert inference.null_spread(even, "g", "n", "w", 100).first().p_value > 0.5
    assert inference.null_spread(wide, "g", "n", "w", 100).first().p_value == 0
    large = spark.createDataFrame([(i, 50000, 25000 + 10 * i) for i in range(5)], "g bigint, n bigint, w bigint")
    assert 0 <= inference.null_spread(large, "g", "n", "w", 100).first().p_value <= 1
    # two equal groups: the range is the difference of two binomial rates, whatever the groups' size
    for size in (100, 4000, 1_000_000):
        two = spark.createDataFrame([(1, size, size // 4), (2, size, size // 4), (3, 5, 5)], "g bigint, n bigint, w bigint")
        got = inference.null_spread(two, "g", "n", "w", 4000).first()
        assert got.observed_range == 0 and got.p_value == 1
        rate = (size // 4 * 2 + 5) / (2 * size + 5)
        assert got.chance_median == pytest.approx(0.6745 * np.sqrt(2 * rate * (1 - rate) / size), rel=0.12)


def test_polychoric_recovers_the_correlation(spark):
    rng = np.random.default_rng(2)
    z = rng.multivariate_normal([0, 0], [[1, 0.4], [0.4, 1]], 30000)
    cut = lambda v: np.digitize(v, np.quantile(v, [1 / 3, 2 / 3]))
    df = spark.createDataFrame(pd.DataFrame({"a": cut(z[:, 0]), "b": cut(z[:, 1])}))
    r = inference.polychoric(inference.ordinal_tables(df, [("a", "b")])).first()
    assert r.r == pytest.approx(0.4, abs=0.03)


def test_fits_satisfy_their_score_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 4000)
    y = rng.poisson(np.exp(0.3 + 0.5 * x))
    nb = rng.negative_binomial(1, 1 / (1 + np.exp(0.2 + 0.4 * x)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "nb": nb}))
    m = models.fit_poisson(df, ["x"], "y")
    fitted = models.linear_mean(df, m, ["x"], "m")
    s = fitted.agg(F.sum(F.col("y") - F.col("m")).alias("a"), F.sum((F.col("y") - F.col("m")) * F.col("x")).alias("b")).first()
    assert abs(s.a) < 1e-3 and abs(s.b) < 1e-3
    beta = models.fit_negative_binomial(df, ["x"], "nb")
    assert beta == pytest.approx([0.2, 0.4], abs=0.12)


def test_profile_grid_equals_a_profile_per_window(spark, monkeypatch):
    """One pass for many windows against one pass for each, over chunks that are short and long."""
    from touchline.operators import ordered, profiles

    r = random.Random(8)
    rows = [(i, f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", "L", f"t{r.randint(0, 2)}", f"t{r.randint(3, 5)}",
             *[None if r.random() < 0.1 else r.randint(0, 5) for _ in range(10)]) for i in range(300)]
    kinds = "match_id int, match_date string, league string, home string, away string, hg int, ag int, hc int, ac int, hy int, ay int, hr int, ar int, hst int, ast int"
    m = spark.createDataFrame(rows, kinds).withColumn("match_date", F.col("match_date").cast("date"))
    for chunk in (7, 5000):
        for module in (ordered, profiles):
            monkeypatch.setattr(module, "ROLLING_CHUNK", chunk)
        grid = profiles.profile_grid(m, [0, 3, 12], 2).collect()
        assert len(grid) == 900
        got = {(x.window, x.match_id): x for x in grid}
        for window in (0, 3, 12):
            for x in profiles.match_profiles(m, window or None, 2).collect():
                for side in ("home", "away"):
                    for c in profiles.METRICS:
                        a, b = x[f"{side}_{c}"], got[window, x.match_id][f"{side}_{c}"]
                        assert (a is None and b is None) or abs(a - b) < 1e-9


def test_grouped_bootstrap_draws_a_group_in_one_task(spark, monkeypatch):
    """Its replicates never move; large groups, whose replicates do, and groups in many tasks have the same intervals."""
    rng = np.random.default_rng(8)
    rows = [(g, u, float(rng.normal()) if u % 7 else None, 0 if g == 3 else 1) for g, n in ((1, 5), (2, 400), (3, 30), (4, 1300)) for u in range(n)]
    df = spark.createDataFrame(rows, "g long, id long, x double, n int")
    ask = lambda: inference.bootstrap(df, "id", ["x", "n"], {"m": ratio("x", "n")}, 300, 5, ["g"])
    whole = ask()
    assert "replicate" not in whole._jdf.queryExecution().executedPlan().toString()
    got = {r.g: r for r in whole.collect()}
    monkeypatch.setattr(inference, "WHOLE_GROUP", 350)
    monkeypatch.setattr(inference, "UNITS_KEPT", 600)
    split = {r.g: r for r in ask().collect()}
    monkeypatch.setattr(inference, "WHOLE_GROUP", 0)
    spread = {r.g: r for r in ask().collect()}
    assert set(got) == set(split) == set(spread) == {1, 2, 3, 4} and got[3].m_low is None and spread[3].m_low is None
    for g in (1, 2, 4):
        for other in (split, spread):
            assert (got[g].units, got[g].m_value) == (other[g].units, pytest.approx(other[g].m_value))
            assert (got[g].m_low, got[g].m_high) == (pytest.approx(other[g].m_low), pytest.approx(other[g].m_high))
    assert got[1].m_low < got[1].m_value < got[1].m_high
