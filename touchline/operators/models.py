"""Fitted models: generalised linear models, walk-forward forecasts and stacking.

Every fit is a few aggregates over the data: the driver sees one row of sums per step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import ratio
from touchline.functions.probability import ln_gamma
from touchline.operators import scoreline
from touchline.operators.ranking import union_all
from touchline.session import settle

GOAL_COLUMNS = ["home_goals_for", "home_goals_against", "home_corners", "home_cards", "away_goals_for",
                "away_goals_against", "away_corners", "away_cards"]
MIN_TRAINING = 300


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def fit_poisson(df: DataFrame, columns: list[str], label: str):
    """Poisson regression with log link."""
    data = assembled(df.filter(F.col(label).isNotNull()), columns).withColumn("_y", F.col(label).cast("double"))
    return GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol="_y",
                                       maxIter=25, tol=1e-8).fit(data)


def linear_mean(df: DataFrame, model, columns: list[str], out: str) -> DataFrame:
    """exp(intercept + coefficients) as a plain expression, so scoring stays in generated code."""
    eta = F.lit(float(model.intercept))
    for c, b in zip(columns, model.coefficients):
        eta = eta + F.col(c) * float(b)
    return df.withColumn(out, F.exp(eta))


class GoalModel:
    """Two Poisson regressions and a low-score correction."""

    def __init__(self, columns: list[str] | None = None):
        self.columns = list(columns or GOAL_COLUMNS)

    def fit(self, train: DataFrame) -> GoalModel:
        train = settle(train.select("hg", "ag", *self.columns).dropna())
        self.home = fit_poisson(train, self.columns, "hg")
        self.away = fit_poisson(train, self.columns, "ag")
        self.rho = scoreline.fit_rho(self.expected(train), "lam", "mu", "hg", "ag")
        return self

    def expected(self, df: DataFrame) -> DataFrame:
        return linear_mean(linear_mean(df, self.home, self.columns, "lam"), self.away, self.columns, "mu")

    def predict(self, df: DataFrame) -> DataFrame:
        return scoreline.outcome_probabilities(self.expected(df.dropna(subset=self.columns)), "lam", "mu", self.rho)


def walk_forward(features: DataFrame, columns: list[str], period: str = "season", day: str = "match_date",
                 min_training: int = MIN_TRAINING) -> DataFrame:
    """Predict each season with a model that saw only earlier dates. Seasons are few, each fit is distributed."""
    known = settle(features.dropna(subset=[*columns, "hg", "ag"]))
    starts = known.groupBy(period).agg(F.min(day).alias("start")).orderBy(period).collect()
    parts = []
    for row in starts:
        train = known.filter(F.col(day) < F.lit(row["start"]))
        if train.count() < min_training:
            continue
        test = known.filter(F.col(period) == row[period])
        parts.append(GoalModel(columns).fit(train).predict(test))
    if parts:
        return union_all(parts)
    none = F.lit(None).cast("double")
    return known.limit(0).withColumns({c: none for c in ("lam", "mu", "p_draw", "p_home", "p_away")})


def _normal_equations(df: DataFrame, columns: list[str], weight, response):
    """One aggregate: the weighted cross products of an intercept and the columns, and with the response."""
    xs = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    k = len(xs)
    terms = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum(weight * xs[i] * xs[j]).alias(f"g{i}_{j}") for i, j in terms],
                 *[F.sum(weight * xs[i] * response).alias(f"r{i}") for i in range(k)]).first()
    gram = np.zeros((k, k))
    for i, j in terms:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
    return gram, np.array([row[f"r{i}"] for i in range(k)])


def fit_negative_binomial(df: DataFrame, columns: list[str], label: str, alpha: float = 1.0,
                          steps: int = 25, tol: float = 1e-8) -> list[float]:
    """Log-link negative binomial with fixed dispersion: intercept and coefficients.

    Reweighted least squares, one aggregate per step.
    """
    data = settle(df.select(*columns, F.col(label).cast("double").alias("_y")).dropna())
    mean = data.agg(F.avg("_y")).first()[0]
    beta = np.zeros(len(columns) + 1)
    beta[0] = math.log(max(mean, 1e-6))
    for _ in range(steps):
        eta = F.lit(float(beta[0]))
        for c, b in zip(columns, beta[1:]):
            eta = eta + F.col(c) * float(b)
        step = data.withColumn("_eta", eta).withColumn("_mu", F.exp("_eta"))
        mu = F.col("_mu")
        gram, right = _normal_equations(step, columns, mu / (1 + alpha * mu), F.col("_eta") + (F.col("_y") - mu) / mu)
        new = np.linalg.solve(gram, right)
        done = float(np.max(np.abs(new - beta))) < tol
        beta = new
        if done:
            break
    return [float(b) for b in beta]


def fit_multinomial(df: DataFrame, columns: list[str], label: str):
    """Unpenalised multinomial logit; `label` holds 0..k-1."""
    data = assembled(df, columns).withColumn("_y", F.col(label).cast("double"))
    return LogisticRegression(family="multinomial", regParam=0.0, featuresCol="features", labelCol="_y",
                              maxIter=200, tol=1e-8).fit(data)


def class_probabilities(model, df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    out = model.transform(assembled(df, columns)).withColumn("_p", vector_to_array("probability"))
    return out.withColumns({n: F.col("_p")[i] for i, n in enumerate(names)}).drop(
        "_p", "features", "rawPrediction", "probability", "prediction")


def log_ratios(df: DataFrame, prefix: str) -> DataFrame:
    """ln(home / draw) and ln(away / draw) of one set of probabilities."""
    floor = F.lit(1e-12)
    d = F.greatest(F.col(f"{prefix}_draw"), floor)
    return df.withColumns({f"{prefix}_lh": F.ln(F.greatest(F.col(f"{prefix}_home"), floor) / d),
                           f"{prefix}_la": F.ln(F.greatest(F.col(f"{prefix}_away"), floor) / d)})


CLASSES = {"H": 0, "A": 3}  # place of each class's three parameters; the draw is the reference


def platt_rows(df: DataFrame, prefix: str, actual: str = "actual", period: str = "season") -> DataFrame:
    """Log ratios of one set of probabilities with the outcome, once for every later season: the rows a recalibration may see."""
    known = log_ratios(df, prefix).filter(F.col(actual).isNotNull() & F.col(f"{prefix}_lh").isNotNull() & F.col(f"{prefix}_la").isNotNull())
    known = known.select(period, F.col(actual).alias("y"), F.col(f"{prefix}_lh").alias("lh"), F.col(f"{prefix}_la").alias("la"))
    seasons = sorted(r[0] for r in known.select(period).distinct().collect())
    return later_seasons(known, seasons, period)


def platt_probabilities(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Recalibrated probabilities ph and pa (and pd) of the rows by the fit of their `fitted_for`."""
    t = F.col("theta")
    eta = {c: t[k] + t[k + 1] * F.col("lh") + t[k + 2] * F.col("la") for c, k in CLASSES.items()}
    top = F.greatest(F.lit(0.0), eta["H"], eta["A"])
    e = {c: F.exp(v - top) for c, v in (*eta.items(), ("D", F.lit(0.0)))}
    total = e["H"] + e["A"] + e["D"]
    return rows.join(fits, "fitted_for").withColumns({"ph": e["H"] / total, "pa": e["A"] / total, "pd": e["D"] / total}).drop("theta")


def fit_platt(rows: DataFrame, min_training: int = MIN_TRAINING, steps: int = 50, tol: float = 1e-9) -> DataFrame:
    """Multinomial recalibration (fitted_for, theta): a logit of the outcome on both log ratios, one fit per season.

    All seasons advance together, each step is one aggregate of 24 sums per season; the fit starts at the forecasts as they are.
    Seasons with fewer than `min_training` earlier matches, or earlier matches of fewer than three outcomes, have none.
    """
    spark = rows.sparkSession
    rows = settle(rows)
    ready = rows.groupBy("fitted_for").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("k")).collect()
    theta = {r.fitted_for: np.array([0, 1, 0, 0, 0, 1.0]) for r in ready if r.n >= min_training and r.k == 3}
    kind = dict(rows.dtypes)["fitted_for"]

    def table() -> DataFrame:
        return spark.createDataFrame([(k, v.tolist()) for k, v in theta.items()], f"fitted_for {kind}, theta array<double>")

    x = [F.lit(1.0), F.col("lh"), F.col("la")]
    p = {"H": F.col("ph"), "A": F.col("pa")}
    open_ = set(theta)
    for _ in range(steps):
        if not open_:
            return table()
        sums = [F.sum(x[k] * ((F.col("y") == c).cast("double") - p[c])).alias(f"g{at + k}") for c, at in CLASSES.items() for k in range(3)]
        for c, at in CLASSES.items():
            for d, to in CLASSES.items():
                if to >= at:
                    w = p[c] * ((1.0 if c == d else 0.0) - p[d])
                    sums += [F.sum(w * x[k] * x[j]).alias(f"h{at + k}_{to + j}") for k in range(3) for j in range(k, 3)]
        for r in platt_probabilities(rows, table()).groupBy("fitted_for").agg(*sums).collect():
            g, h = np.array([r[f"g{k}"] for k in range(6)]), np.zeros((6, 6))
            for at, to in ((0, 0), (0, 3), (3, 3)):
                for k in range(3):
                    for j in range(k, 3):
                        v = r[f"h{at + k}_{to + j}"]
                        h[at + k, to + j] = h[at + j, to + k] = h[to + j, at + k] = h[to + k, at + j] = v
            step = np.linalg.lstsq(h, g, rcond=1e-12)[0]
            theta[r.fitted_for] = theta[r.fitted_for] + step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
            if g @ step < tol:
                open_.discard(r.fitted_for)
    raise RuntimeError(f"recalibration did not settle in {steps} steps")


def recalibrated(df: DataFrame, fits: DataFrame, prefix: str, out: str = "r", period: str = "season") -> DataFrame:
    """The rows of seasons that have a fit, with probabilities corrected by it; it saw earlier seasons only."""
    rows = log_ratios(df, prefix).withColumnsRenamed({f"{prefix}_lh": "lh", f"{prefix}_la": "la"}).withColumn("fitted_for", F.col(period))
    names = {"ph": f"{out}_home", "pa": f"{out}_away", "pd": f"{out}_draw"}
    return platt_probabilities(rows, fits).withColumnsRenamed(names).drop("lh", "la", "fitted_for")


def stacking(evaluated: DataFrame, min_training: int = MIN_TRAINING) -> DataFrame:
    """Does the model add to the market? Walk-forward logits on market log-ratios alone and with the model's."""
    y = F.when(F.col("actual") == "D", 0).when(F.col("actual") == "H", 1).otherwise(2)
    d = log_ratios(log_ratios(evaluated, "p"), "m").withColumn("y", y)
    d = settle(d.select("match_id", "season", "match_date", "y", "p_lh", "p_la", "m_lh", "m_la", "m_draw", "m_home", "m_away"))
    parts = []
    for row in d.groupBy("season").agg(F.count(F.lit(1)).alias("n")).orderBy("season").collect()[1:]:
        train, test = d.filter(F.col("season") < row["season"]), d.filter(F.col("season") == row["season"])
        if train.count() < min_training or train.select("y").distinct().count() < 3:
            continue
        own = lambda ps: F.element_at(F.array(*[F.col(p) for p in ps]), F.col("y") + 1)
        out = test.withColumn("ll_market", -F.ln(F.greatest(own(["m_draw", "m_home", "m_away"]), F.lit(1e-12))))
        for name, cols in (("alone", ["m_lh", "m_la"]), ("both", ["m_lh", "m_la", "p_lh", "p_la"])):
            fitted = fit_multinomial(train, cols, "y")
            out = class_probabilities(fitted, out, cols, ["q0", "q1", "q2"]).withColumn(
                f"ll_{name}", -F.ln(F.greatest(own(["q0", "q1", "q2"]), F.lit(1e-12)))).drop("q0", "q1", "q2")
        parts.append(out.select("match_id", "season", "ll_market", "ll_alone", "ll_both"))
    if not parts:
        return d.limit(0).select("match_id", "season", *[F.lit(0.0).alias(c) for c in ("ll_market", "ll_alone", "ll_both")])
    return union_all(parts)


def poisson_fit_quality(df: DataFrame, label: str, mean: str) -> DataFrame:
    """Log-likelihood, null log-likelihood and pseudo R2 of a Poisson mean, from sums."""
    y, m = F.col(label).cast("double"), F.col(mean)
    base = df.agg(F.avg(y)).scalar()
    d = df.withColumn("_base", base)
    ll = F.sum(y * F.ln(m) - m - ln_gamma(y + 1))
    null = F.sum(y * F.ln("_base") - F.col("_base") - ln_gamma(y + 1))
    return d.agg(F.count(F.lit(1)).alias("n"), ll.alias("log_likelihood"), null.alias("null_log_likelihood")).withColumn(
        "pseudo_r2", 1 - F.col("log_likelihood") / F.col("null_log_likelihood"))


def sparse_row(numeric: list[str], factors: list[str]) -> Column:
    """A row of a design matrix by name: 1 for `const`, the numeric columns, and 1 for each factor's level, as `column=level`."""
    named = [F.struct(F.lit("const").alias("j"), F.lit(1.0).alias("x"))]
    named += [F.struct(F.lit(c).alias("j"), F.col(c).cast("double").alias("x")) for c in numeric]
    named += [F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("j"), F.lit(1.0).alias("x")) for c in factors]
    return F.array(*named)


def design_rows(df: DataFrame, keys: list[str], label: str, designs: dict[str, tuple[list[str], list[str]]], keep: list[str] | None = None) -> DataFrame:
    """Every row once per model: keys, model, _y and the model's sparse row _f. Rows that lack any model's column are left out."""
    used = sorted({c for numeric, factors in designs.values() for c in (*numeric, *factors)})
    full = df.dropna(subset=[*keys, label, *used])
    models = F.array(*[F.struct(F.lit(name).alias("model"), sparse_row(*d).alias("_f")) for name, d in designs.items()])
    return full.select(*keys, *(keep or []), F.col(label).cast("double").alias("_y"), F.explode(models).alias("_m")).select(
        *keys, *(keep or []), "_m.model", "_y", "_m._f")


def sparse_mean(rows: DataFrame, fits: DataFrame, keys: list[str], out: str = "_mu") -> DataFrame:
    """Expected value of every sparse row by the fit of its keys; a level the fit has not seen counts as the reference."""
    eta = F.aggregate("_f", F.lit(0.0), lambda s, f: s + f["x"] * F.coalesce(F.col("beta")[f["j"]], F.lit(0.0)))
    return rows.join(fits.select(*keys, "beta"), keys).withColumn(out, F.exp(F.least(eta, F.lit(300.0)))).drop("beta")


WHOLE_FIT = 200_000  # rows (once for each value of a list) of fits that one task works out from the first step to the last
FIT_BATCH = 40_000  # rows whose fits a task advances together


def fit_sparse_poisson(rows: DataFrame, keys: list[str], steps: int = 40, tol: float = 1e-6, least: int = 1) -> DataFrame:
    """Poisson regressions with log link of sparse rows (_y, _f), one for every value of the keys: (keys, beta, rank, left).

    Newton steps, each solved by least norm, so that factors need no level left out and `rank` is the number of free
    parameters. A fit has as many names as its factors have levels, the square of which one task holds. A key may be a list
    (see `later_seasons`): its row counts for the fit of each value. Keys with fewer than `least` rows have no fit. Steps end
    when no fit can gain more than `tol` in log-likelihood (`left` is what is left), or raise an error after `steps`.

    Rows move once, to tasks that hold all rows of the keys that are no lists: there many fits advance together in vectors.
    Where such keys have more than `WHOLE_FIT` rows, a step is an aggregate over all tasks instead (`_fit_spread`).
    """
    lists = [k for k in keys if dict(rows.dtypes)[k].startswith("array")]
    if len(lists) > 1:
        raise ValueError("one key may be a list")
    plain = [k for k in keys if k not in lists]
    rows = rows.dropna(subset=keys)
    if lists:
        rows = rows.filter(F.size(lists[0]) > 0)
    kinds = {k: kind.removeprefix("array<").removesuffix(">") if k in lists else kind for k, kind in rows.dtypes if k in keys}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", beta map<string, double>, rank int, left double"
    weight = F.size(lists[0]) if lists else F.lit(1)
    large = settle(rows.groupBy(*plain).agg(F.sum(weight).alias("_n")).filter(F.col("_n") > WHOLE_FIT).drop("_n"))
    some = large.count()
    near = rows.join(large, plain, "left_anti") if some else rows
    near = near.select(*keys, "_y", F.col("_f.j").alias("_j"), F.col("_f.x").alias("_x")).repartition(*plain).sortWithinPartitions(*plain)
    fits = settle(near.mapInArrow(_whole_fits(keys, plain, lists, steps, tol, least), schema))
    left = fits.agg(F.max("left")).first()[0]
    if left is not None and left >= tol:
        raise RuntimeError(f"a fit can still gain {left} in log-likelihood after {steps} steps")
    if not some:
        return fits
    far = rows.join(large, plain, "left_semi")
    for k in lists:
        far = far.withColumn(k, F.explode(k))
    far = settle(far.select(*keys, "_y", "_f"))
    enough = far.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return fits.unionByName(_fit_spread(far.join(enough, keys, "left_semi"), keys, schema, steps, tol))


def _whole_fits(keys: list[str], plain: list[str], lists: list[str], steps: int, tol: float, least: int):
    """For mapInArrow over rows that are in order of the plain keys: the fits of batches of whole keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch.column("_j")) if not lists else pc.sum(pc.list_value_length(batch.column(lists[0]))).as_py()
            if size >= FIT_BATCH:
                rows = pa.Table.from_batches(held)
                starts = _first_rows(rows, plain)
                if starts[-1]:
                    yield from _fit_batch(rows.slice(0, starts[-1]), starts[:-1])
                    rows = rows.slice(starts[-1])
                held = rows.combine_chunks().to_batches()
                size = 0
        if held:
            rows = pa.Table.from_batches(held)
            yield from _fit_batch(rows, _first_rows(rows, plain))

    def _fit_batch(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        cluster = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        if lists:
            column = rows.column(lists[0]).combine_chunks()
            row = np.repeat(np.arange(len(rows)), column.value_lengths().to_numpy(zero_copy_only=False))
            values = column.flatten().dictionary_encode()
            code = cluster[row] * len(values.dictionary) + values.indices.to_numpy(zero_copy_only=False)
        else:
            row, code = np.arange(len(rows)), cluster
        codes, fit, counts = np.unique(code, return_inverse=True, return_counts=True)
        if counts.min() < least:
            kept = counts >= least
            row = row[kept[fit]]
            fit = (np.cumsum(kept) - 1)[fit[kept[fit]]]
            codes = codes[kept]
        if not len(codes):
            return
        j, x = (rows.column(c).combine_chunks() for c in ("_j", "_x"))
        names = j.flatten().dictionary_encode()
        lengths = j.value_lengths().to_numpy(zero_copy_only=False)
        found = newton_fits(rows.column("_y").to_numpy(), np.cumsum(lengths) - lengths, lengths, names.indices.to_numpy(zero_copy_only=False),
                            x.flatten().to_numpy(zero_copy_only=False), row, fit, names.dictionary.to_pylist(), steps, tol)
        at, name, beta, rank, left = found
        home = codes // len(values.dictionary) if lists else codes
        out = {k: rows.column(k).take(pa.array(starts[home])).combine_chunks() for k in plain}
        if lists:
            out[lists[0]] = values.dictionary.take(pa.array(codes % len(values.dictionary)))
        out["beta"] = pa.MapArray.from_arrays(pa.array(at, pa.int32()), names.dictionary.take(pa.array(name)), pa.array(beta))
        out["rank"], out["left"] = pa.array(rank, pa.int32()), pa.array(left)
        order = [*keys, "beta", "rank", "left"]
        yield pa.RecordBatch.from_arrays([out[c] for c in order], order)

    return run


def _first_rows(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where another value of the keys begins, in rows ordered by them."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in keys:
        code = rows.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def newton_fits(y: np.ndarray, first: np.ndarray, lengths: np.ndarray, j: np.ndarray, x: np.ndarray, row: np.ndarray, fit: np.ndarray,
                names: list[str], steps: int, tol: float):
    """Poisson fits that advance together: (start of each fit's names, names, coefficients, rank, what is left to gain).

    A row's entries are j, x from `first` on, `lengths` of them; an observation is a row in a fit. All names of all fits lie in
    one vector, all systems in another, and a step adds up into both.
    """
    fits, obs = int(fit.max()) + 1, np.arange(len(row))
    y, count = y[row].astype(float), lengths[row]
    of = np.repeat(obs, count)  # observation of each entry
    entry = np.repeat(first[row] - (np.cumsum(count) - count), count) + np.arange(len(of))
    x = x[entry].astype(float)
    key = fit[of].astype(np.int64) * len(names) + j[entry]
    if fits * len(names) <= 8 * len(key) + 1000:
        seen = np.zeros(fits * len(names), bool)
        seen[key] = True
        cols, col = np.flatnonzero(seen), (np.cumsum(seen) - 1)[key]
    else:
        cols, col = np.unique(key, return_inverse=True)
    name, home = cols % len(names), cols // len(names)
    p = np.bincount(home, minlength=fits)
    at = np.append(0, np.cumsum(p))
    cell = np.append(0, np.cumsum(p * p))
    place, weight, who = [], [], []  # products of two entries of an observation: their cell, their product, the observation
    begin = np.cumsum(count) - count
    for k in np.unique(count):
        mine = obs[count == k]
        f = fit[mine]
        c = [col[begin[mine] + a] for a in range(k)]
        v = [x[begin[mine] + a] for a in range(k)]
        for a in range(k):
            for b in range(a, k):
                low, high = np.minimum(c[a], c[b]) - at[f], np.maximum(c[a], c[b]) - at[f]
                place.append(cell[f] + low * p[f] + high)
                weight.append(v[a] * v[b] * (2.0 if a < b else 1.0) ** (low == high))
                who.append(mine)
    place, weight, who = (np.concatenate(z) for z in (place, weight, who))
    beta = np.zeros(len(cols))
    if "const" in names:
        mean = np.bincount(fit, y, fits) / np.maximum(np.bincount(fit, minlength=fits), 1)
        const = name == names.index("const")
        beta[const] = np.log(np.maximum(mean[home[const]], 1e-6))
    rank, left = np.zeros(fits, int), np.zeros(fits)
    for _ in range(steps):
        mu = np.exp(np.minimum(np.bincount(of, x * beta[col], len(obs)), 300.0))
        slope = np.bincount(col, x * (y - mu)[of], len(cols))
        curve = np.bincount(place, weight * mu[who], cell[-1])
        for size in np.unique(p):
            f = np.flatnonzero(p == size)
            h = curve[cell[f][:, None] + np.arange(size * size)].reshape(-1, size, size)
            diagonal = h[:, np.arange(size), np.arange(size)]
            h = h + h.transpose(0, 2, 1)
            h[:, np.arange(size), np.arange(size)] = diagonal
            mine = at[f][:, None] + np.arange(size)
            scale = 1 / np.sqrt(np.maximum(diagonal, 1e-12))  # numbers of unlike size share one cut for the rank
            values, vectors = np.linalg.eigh(h * scale[:, :, None] * scale[:, None, :])
            free = values > 1e-9 * np.maximum(values.max(axis=1, keepdims=True), 0)
            inner = np.einsum("fij,fi->fj", vectors, slope[mine] * scale)
            part = np.where(free, inner / np.where(free, values, 1.0), 0.0)
            step = scale * np.einsum("fij,fj->fi", vectors, part)
            step *= np.minimum(1.0, 3.0 / np.maximum(np.abs(step).max(axis=1), 1e-12))[:, None]  # a start far off must not overshoot
            beta[mine] += step
            rank[f], left[f] = free.sum(axis=1), (inner * part).sum(axis=1)
        if left.max() < tol:
            break
    return at, name, beta, rank, left


def _fit_spread(rows: DataFrame, keys: list[str], schema: str, steps: int, tol: float) -> DataFrame:
    """The fits of many rows each, which all advance together. A step is one aggregate: a row gives the products of its own few
    entries only, which are added up per pair of names before they move; then each fit's small system is solved in a task."""
    rows = settle(rows)
    start = rows.groupBy(*keys).agg(F.avg("_y").alias("_m"))
    fits = settle(start.select(*keys, F.create_map(F.lit("const"), F.ln(F.greatest("_m", F.lit(1e-6)))).alias("beta")))

    def solve(sums: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        beta = dict(fit["beta"].iloc[0]) if len(fit) else {}
        slope = sums[sums["i"] == ""].set_index("j")["v"]
        at = {name: n for n, name in enumerate(sorted(slope.index))}
        pairs = sums[sums["i"] != ""]
        curve = np.zeros((len(at), len(at)))
        i, j = pairs["i"].map(at).to_numpy(), pairs["j"].map(at).to_numpy()
        curve[i, j] = curve[j, i] = pairs["v"].to_numpy()
        g = slope.sort_index().to_numpy()
        scale = 1 / np.sqrt(np.maximum(np.diag(curve), 1e-12))  # numbers of unlike size share one cut for the rank
        values, vectors = np.linalg.eigh(curve * scale[:, None] * scale)
        free = values > 1e-9 * values.max(initial=0)
        inner = vectors[:, free].T @ (g * scale)
        step = scale * (vectors[:, free] @ (inner / values[free]))
        step *= min(1.0, 3.0 / max(np.abs(step).max(initial=0), 1e-12))  # a start far off must not overshoot
        new = {name: beta.get(name, 0.0) + float(step[n]) for name, n in at.items()}
        key = {k: [sums[k].iloc[0]] for k in keys}
        return pd.DataFrame(key | {"beta": [new], "rank": [int(free.sum())], "left": [float((inner**2 / values[free]).sum())]})

    for _ in range(steps):
        now = sparse_mean(rows, fits, keys)
        mu, y = F.col("_mu"), F.col("_y")
        slopes = F.transform("_f", lambda a: F.struct(F.lit("").alias("i"), a["j"].alias("j"), (a["x"] * (y - mu)).alias("v")))
        curves = F.flatten(F.transform("_f", lambda a: F.transform(
            F.filter("_f", lambda b: b["j"] >= a["j"]), lambda b: F.struct(a["j"].alias("i"), b["j"].alias("j"), (mu * a["x"] * b["x"]).alias("v")))))
        sums = now.select(*keys, F.inline(F.concat(slopes, curves))).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
        old = fits.select(*[F.col(k).alias(f"_old_{k}") for k in keys], "beta").groupBy(*[f"_old_{k}" for k in keys])
        fits = settle(sums.groupBy(*keys).cogroup(old).applyInPandas(solve, schema))
        left = fits.agg(F.max("left")).first()[0]
        if left is None or left < tol:
            return fits
    raise RuntimeError(f"a fit can still gain {left} in log-likelihood after {steps} steps")


def fit_table(rows: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Per fit: rows, free parameters, log-likelihood, AIC, and pseudo R2 (McFadden) against the plain mean."""
    mean = rows.groupBy(*keys).agg(F.avg("_y").alias("_base"))
    y, m = F.col("_y"), F.col("_mu")
    ll = F.sum(y * F.ln(m) - m - ln_gamma(y + 1))
    null = F.sum(F.when(F.col("_base") > 0, y * F.ln("_base") - F.col("_base") - ln_gamma(y + 1)).otherwise(0.0))
    out = sparse_mean(rows, fits, keys).join(mean, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ll.alias("log_likelihood"), null.alias("_null"))
    return out.join(fits.select(*keys, F.col("rank").alias("parameters")), keys).withColumns({
        "aic": 2 * F.col("parameters") - 2 * F.col("log_likelihood"), "pseudo_r2": 1 - ratio("log_likelihood", "_null")}).drop("_null")


def likelihood_ratio_tests(table: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Named comparisons of a small model with one that holds it: statistic, degrees of freedom and p."""
    from touchline.operators.inference import chi_square_tail

    wanted = F.explode(F.array(*[F.struct(F.lit(a).alias("small"), F.lit(b).alias("large")) for a, b in pairs])).alias("_p")
    asked = table.select(*keys, wanted).distinct().select(*keys, "_p.*")
    one = table.select(*keys, F.col("model").alias("small"), F.col("log_likelihood").alias("_l0"), F.col("parameters").alias("_k0"))
    two = table.select(*keys, F.col("model").alias("large"), F.col("log_likelihood").alias("_l1"), F.col("parameters").alias("_k1"))
    both = asked.join(one, [*keys, "small"]).join(two, [*keys, "large"]).withColumns(
        {"lr": F.greatest(2 * (F.col("_l1") - F.col("_l0")), F.lit(0.0)), "dof": F.col("_k1") - F.col("_k0")})
    p = F.when(F.col("dof") > 0, chi_square_tail("lr", "dof"))
    return both.select(*keys, "small", "large", "lr", "dof", p.alias("p_value"))


def score_sums(rows: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Observed and expected total behind every name of every fit; at the fit they are equal."""
    each = sparse_mean(rows, fits, keys).select(*keys, "_y", "_mu", F.inline("_f"))
    return each.groupBy(*keys, F.col("j").alias("name")).agg(
        F.sum(F.col("_y") * F.col("x")).alias("observed"), F.sum(F.col("_mu") * F.col("x")).alias("expected"))


def later_seasons(rows: DataFrame, seasons: list, period: str = "season", listed: bool = False) -> DataFrame:
    """Training rows for every later season: `fitted_for` names the season whose forecasts a row helps to fit.

    With `listed` a row stays one row and has the list of these seasons, for `fit_sparse_poisson`.
    """
    ahead = F.filter(F.array(*[F.lit(s) for s in seasons]), lambda s: s > F.col(period))
    return rows.withColumn("fitted_for", ahead if listed else F.explode(ahead))


def team_effects(df: DataFrame, value: str, keys: list[str], context: str, rounds: int = 8) -> DataFrame:
    """Multiplicative team and context effects of a Poisson mean by iterative proportional fitting.

    In turn, a team's effect is its total over the sum of its counts times the contexts' effects, and a context's likewise.
    Each round is one aggregate of the counts per team, and only one number per context, a handful, comes to the driver.
    Returns the observed and expected mean and their difference per team and context.
    """
    cells = df.groupBy(*keys, context).agg(F.sum(value).cast("double").alias("s"), F.count(value).cast("double").alias("n"))
    teams = settle(cells.groupBy(*keys).agg(
        F.sum("s").alias("_total"), F.collect_list(F.struct(F.col(context).alias("c"), "s", "n")).alias("_cells")))
    known = [row.c for row in teams.select(F.explode("_cells").alias("x")).select("x.c").distinct().collect()]
    effect = dict.fromkeys(known, 1.0)

    def with_team_effect() -> DataFrame:
        by = F.create_map(*[F.lit(v) for pair in effect.items() for v in pair])
        exposure = F.aggregate("_cells", F.lit(0.0), lambda a, x: a + x["n"] * by[x["c"]])
        return teams.select(*keys, (F.col("_total") / exposure).alias("_a"), F.explode("_cells").alias("_x"), by.alias("_by"))

    for _ in range(rounds if known else 0):
        new = with_team_effect().groupBy("_x.c").agg((F.sum("_x.s") / F.sum(F.col("_x.n") * F.col("_a"))).alias("b")).collect()
        effect = {row.c: row.b for row in new}
    if not known:
        return cells.select(*keys, context, *[F.lit(0.0).alias(c) for c in ("observed", "expected", "residual")])
    out = with_team_effect().select(*keys, F.col("_x.c").alias(context), (F.col("_x.s") / F.col("_x.n")).alias("observed"),
                                    (F.col("_a") * F.col("_by")[F.col("_x.c")]).alias("expected"))
    return out.withColumn("residual", F.col("observed") - F.col("expected"))
