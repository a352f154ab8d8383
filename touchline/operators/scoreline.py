"""From expected goals to score and outcome probabilities, without leaving the row."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import col
from touchline.functions.probability import poisson_terms

TOP = 10  # scores 0..10 per side
SIDE = TOP + 1
FLOOR = 1e-12


def score_grid(lam, mu, rho) -> Column:
    """Array of 121 probabilities, index home * 11 + away: two Poissons with the low-score correction.

    Cells are kept at or above 1e-12 and scaled to sum to one.
    """
    lam, mu, rho = col(lam).cast("double"), col(mu).cast("double"), col(rho).cast("double")
    away = poisson_terms(mu, TOP)
    rows = F.transform(poisson_terms(lam, TOP), lambda p, i: F.transform(away, lambda q, j: F.greatest(
        p * q * F.when((i == 0) & (j == 0), 1 - lam * mu * rho)
        .when((i == 0) & (j == 1), 1 + lam * rho)
        .when((i == 1) & (j == 0), 1 + mu * rho)
        .when((i == 1) & (j == 1), 1 - rho).otherwise(1.0), F.lit(FLOOR))))
    return F.flatten(rows)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def grid_sum(grid, keep) -> Column:
    """Total of the cells for which keep(home goals, away goals) holds, over the grid's total."""
    g = col(grid)
    part = F.filter(g, lambda _, k: keep(F.floor(k / SIDE), k % SIDE))
    return F.coalesce(_sum(part), F.lit(0.0)) / _sum(g)


def _terms(df: DataFrame, mean: str, name: str) -> DataFrame:
    """Columns name0..name10 with P(X = k)."""
    m = F.col(mean)
    return df.withColumns({f"{name}{k}": F.exp(-m) * F.pow(m, F.lit(k)) / math.factorial(k) for k in range(SIDE)})


def _low_scores(rho) -> dict[tuple[int, int], Column]:
    """Corrected and floored probabilities of the four scores that the correction touches."""
    r, lam, mu = col(rho), F.col("_lam"), F.col("_mu")
    tau = {(0, 0): 1 - lam * mu * r, (0, 1): 1 + lam * r, (1, 0): 1 + mu * r, (1, 1): 1 - r}
    return {(i, j): F.greatest(F.col(f"_h{i}") * F.col(f"_a{j}") * t, F.lit(FLOOR)) for (i, j), t in tau.items()}


def _plain(i: int, j: int) -> Column:
    return F.col(f"_h{i}") * F.col(f"_a{j}")


def outcome_probabilities(df: DataFrame, lam: str, mu: str, rho) -> DataFrame:
    """Add p_draw, p_home, p_away (NULL where an expectation is missing).

    Sums over the grid factor into the two sides' terms, so plain arithmetic in generated code replaces 121 cells;
    only the four corrected scores are formed. (The 1e-12 floor of the other cells is below 2e-10 in total.)
    """
    out = _terms(_terms(df.withColumns({"_lam": col(lam).cast("double"), "_mu": col(mu).cast("double")}),
                        "_lam", "_h"), "_mu", "_a")
    low = _low_scores(rho)
    change = {k: v - _plain(*k) for k, v in low.items()}
    a = [F.col(f"_a{k}") for k in range(SIDE)]
    out = out.withColumns({f"_b{i}": reduce(lambda x, y: x + y, a[:i]) for i in range(1, SIDE)})
    home = reduce(lambda x, y: x + y, [F.col(f"_h{i}") * F.col(f"_b{i}") for i in range(1, SIDE)])
    draw = reduce(lambda x, y: x + y, [_plain(k, k) for k in range(SIDE)])
    total = reduce(lambda x, y: x + y, [F.col(f"_h{k}") for k in range(SIDE)]) * (
        F.col(f"_b{TOP}") + F.col(f"_a{TOP}"))
    out = out.withColumns({
        "_d": draw + change[0, 0] + change[1, 1], "_w": home + change[1, 0],
        "_t": total + change[0, 0] + change[0, 1] + change[1, 0] + change[1, 1]})
    out = out.withColumns({"p_draw": F.col("_d") / F.col("_t"), "p_home": F.col("_w") / F.col("_t"),
                           "p_away": (F.col("_t") - F.col("_d") - F.col("_w")) / F.col("_t")})
    return out.select(*df.columns, "p_draw", "p_home", "p_away")


def naive_expectations(profiles: DataFrame, low: float = 0.05) -> DataFrame:
    """Expected goals as the mean of one side's attack and the other's defence (no fit)."""
    lam = (F.col("home_goals_for") + F.col("away_goals_against")) / 2
    mu = (F.col("away_goals_for") + F.col("home_goals_against")) / 2
    # `lam + 0` keeps NULLs: greatest() alone would replace a missing value by the bound
    return profiles.withColumns({"lam": F.when(lam.isNotNull(), F.greatest(lam, F.lit(low))),
                                 "mu": F.when(mu.isNotNull(), F.greatest(mu, F.lit(low)))})


def market_probabilities(df: DataFrame, home: str, draw: str, away: str, prefix: str = "m") -> DataFrame:
    """Implied probabilities with the margin removed in proportion; NULL if any price is missing."""
    inv = 1 / F.col(home) + 1 / F.col(draw) + 1 / F.col(away)
    return df.withColumns({f"{prefix}_draw": 1 / F.col(draw) / inv, f"{prefix}_home": 1 / F.col(home) / inv,
                           f"{prefix}_away": 1 / F.col(away) / inv})


def _bisect(value_at, low: float, high: float, steps: int = 50) -> Column:
    """Root of an increasing function of one unknown by fixed halving, as a fold over a literal sequence."""
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        up = value_at(mid) > 0
        return F.struct(F.when(up, acc["lo"]).otherwise(mid).alias("lo"),
                        F.when(up, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve,
                       lambda a: (a["lo"] + a["hi"]) / 2)


def shin_probabilities(df: DataFrame, home: str, draw: str, away: str, prefix: str = "shin") -> DataFrame:
    """Margin removal for a market with a share z of informed bettors (Shin)."""
    prices = {"draw": 1 / F.col(draw), "home": 1 / F.col(home), "away": 1 / F.col(away)}
    book = prices["draw"] + prices["home"] + prices["away"]

    def p(inv, z):
        return (F.sqrt(z * z + 4 * (1 - z) * inv * inv / book) - z) / (2 * (1 - z))

    z = _bisect(lambda z: 1 - (p(prices["draw"], z) + p(prices["home"], z) + p(prices["away"], z)),
                0.0, 0.4)
    out = df.withColumn("_z", z)
    return out.withColumns({f"{prefix}_{k}": p(v, F.col("_z")) for k, v in prices.items()}).drop("_z")


def odds_ratio_probabilities(df: DataFrame, home: str, draw: str, away: str, prefix: str = "oratio") -> DataFrame:
    """Margin removal by one common odds ratio between implied and true probabilities."""
    prices = {"draw": 1 / F.col(draw), "home": 1 / F.col(home), "away": 1 / F.col(away)}

    def p(inv, c):
        return inv / (c + inv - c * inv)

    c = _bisect(lambda c: 1 - (p(prices["draw"], c) + p(prices["home"], c) + p(prices["away"], c)),
                0.2, 5.0)
    out = df.withColumn("_c", c)
    return out.withColumns({f"{prefix}_{k}": p(v, F.col("_c")) for k, v in prices.items()}).drop("_c")


def rho_log_likelihood(df: DataFrame, lam: str, mu: str, home_goals: str, away_goals: str,
                       grid: list[float]) -> DataFrame:
    """Log-likelihood of each candidate correction in one aggregate over all matches."""
    base = df.select(F.col(lam).cast("double").alias("_lam"), F.col(mu).cast("double").alias("_mu"),
                     F.least(F.col(home_goals), F.lit(TOP)).cast("int").alias("_i"),
                     F.least(F.col(away_goals), F.lit(TOP)).cast("int").alias("_j"))
    base = _terms(_terms(base, "_lam", "_h"), "_mu", "_a")
    h, a = ([F.col(f"{s}{k}") for k in range(SIDE)] for s in ("_h", "_a"))
    # only four cells depend on rho: the plain total and the observed cell are formed once per match
    base = base.select("_lam", "_mu", "_i", "_j", *[f"_{s}{k}" for s in "ha" for k in (0, 1)],
                       (reduce(lambda x, y: x + y, h) * reduce(lambda x, y: x + y, a)).alias("_t"),
                       (F.element_at(F.array(*h), F.col("_i") + 1) * F.element_at(F.array(*a), F.col("_j") + 1))
                       .alias("_own"))
    rows = base.withColumn("rho", F.explode(F.array(*[F.lit(float(r)) for r in grid])))
    low = _low_scores("rho")
    total, cell = F.col("_t"), F.greatest("_own", F.lit(FLOOR))
    for (i, j), v in low.items():
        total = total - _plain(i, j) + v
        cell = F.when((F.col("_i") == i) & (F.col("_j") == j), v).otherwise(cell)
    return rows.groupBy("rho").agg(F.sum(F.ln(cell / total)).alias("log_likelihood"),
                                   F.count(F.lit(1)).alias("matches"))


def fit_rho(df: DataFrame, lam: str, mu: str, home_goals: str, away_goals: str, rounds: int = 3) -> float:
    """Maximum-likelihood correction in (-0.3, 0.3): a grid, then finer grids around the best value."""
    low, high = -0.3, 0.3
    best = 0.0
    for _ in range(rounds):
        step = (high - low) / 30
        grid = [low + step * k for k in range(31)]
        row = rho_log_likelihood(df, lam, mu, home_goals, away_goals, grid).agg(
            F.max_by("rho", F.struct("log_likelihood", "rho")).alias("r")).first()
        best = float(row["r"])
        low, high = max(-0.3, best - step), min(0.3, best + step)
    return best
