"""Resampling, exact and rank tests, reliability and ordinal correlation as Spark aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.numeric import pearson, ratio, shrink_half_length
from touchline.functions.probability import (ln_choose, ln_gamma, normal_cdf, normal_quantile, resample_copies, uniforms,
                                             with_uniform)
from touchline.operators.ordered import number_rows
from touchline.session import settle, spread


UNITS_DRAWN = 512  # units whose draws for all replicates a task holds at a time
UNITS_KEPT = 8192  # units whose draws a task keeps for other groups, a byte each
WHOLE_GROUP = 50_000  # units of a group that one task draws alone


def bootstrap(units: DataFrame, unit_id: str, sums: list[str], statistics: dict[str, Column],
              replicates: int = 2000, seed: int = 7, groups: list[str] | None = None,
              few_units: bool = False) -> DataFrame:
    """95 % intervals of statistics that are functions of sums, resampling whole units.

    A unit enters a replicate with Poisson(1) copies, the distributed form of drawing as many units as there are:
    every unit decides alone from a seeded hash. A task draws for a batch of units and all replicates at once and gives
    on one row of partial sums per replicate and group, so units are never multiplied by replicates. Use statistics that
    are ratios of sums, which do not depend on the replicate's size. Block resampling is the same call on rows already
    added up per block; `few_units` spreads such a short table over the cores first. Null sums count as 0.

    With `groups` the units of a group meet in one task, which gives on its interval only; the replicates of groups of more
    than `WHOLE_GROUP` units come from many tasks as without groups.
    """
    everything = not groups
    if everything:
        units, groups = units.withColumn("_all", F.lit(0)), ["_all"]
    else:
        units = settle(units.select(*groups, unit_id, *sums))  # read for their numbers, their sums and their draws
    whole = units.groupBy(*groups).agg(*[F.sum(s).alias(s) for s in sums], F.count(F.lit(1)).alias("units"))
    if everything:
        limits = _spread_limits(spread(units, unit_id) if few_units else units, unit_id, sums, statistics, replicates, seed, groups)
    else:
        large = settle(whole.filter(F.col("units") > WHOLE_GROUP).select(*groups))
        some = large.count()
        near = units.join(large, groups, "left_anti") if some else units
        limits = _group_limits(near, unit_id, sums, statistics, replicates, seed, groups)
        if some:
            far = units.join(large, groups, "left_semi")
            limits = limits.unionByName(_spread_limits(spread(far, *groups, unit_id), unit_id, sums, statistics, replicates, seed, groups))
    whole = whole.select(*groups, "units", *[e.alias(f"{n}_value") for n, e in statistics.items()])
    out = whole.join(limits, groups)
    return out.drop("_all") if everything else out


def _spread_limits(rows: DataFrame, unit_id: str, sums: list[str], statistics: dict[str, Column], replicates: int, seed: int,
                   groups: list[str]) -> DataFrame:
    """Intervals of groups whose units are drawn in many tasks: partial sums of every replicate meet."""
    per = replicate_sums(rows, unit_id, sums, replicates, seed, groups)
    per = per.select(*groups, *[e.alias(n) for n, e in statistics.items()])
    limits = per.groupBy(*groups).agg(*[
        F.percentile(n, F.array(F.lit(0.025), F.lit(0.975))).alias(n) for n in statistics])
    return limits.select(*groups, *[F.col(n)[i].alias(f"{n}_{end}") for n in statistics
                                    for i, end in enumerate(("low", "high"))])


def _group_limits(rows: DataFrame, unit_id: str, sums: list[str], statistics: dict[str, Column], replicates: int, seed: int,
                  groups: list[str]) -> DataFrame:
    """Intervals of groups whose units a task draws alone: replicates follow each other there and never move.

    A group's rows come in order, so a task holds one group's sums; units that recur in several groups are drawn once.
    """
    kinds = dict(rows.dtypes)
    rows = rows.select(*groups, F.col(unit_id).cast("bigint").alias("_unit"), *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s)
                                                                                 for s in sums])
    names = list(statistics)  # columns stay on the driver
    numbers = np.arange(replicates, dtype=np.int64)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, total, drawn = None, None, {}

        def done():
            out = pd.DataFrame(total, columns=sums)
            for name, value in zip(groups, open_):
                out[name] = value
            return out[[*groups, *sums]]

        for batch in batches:
            for key, part in batch.groupby(groups, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != open_:
                    if open_ is not None:
                        yield done()
                    open_, total = key, np.zeros((replicates, len(sums)))
                for at in range(0, len(part), UNITS_DRAWN):
                    some = part.iloc[at:at + UNITS_DRAWN]
                    ids = some["_unit"].to_numpy(np.int64)
                    new = np.unique([i for i in ids.tolist() if i not in drawn]).astype(np.int64)
                    if len(new):
                        if len(drawn) + len(new) > UNITS_KEPT:
                            drawn, new = {}, np.unique(ids)
                        copies = resample_copies(uniforms(seed, new[:, None], numbers[None, :])).astype(np.int8)
                        drawn.update(zip(new.tolist(), copies))
                    total += np.stack([drawn[i] for i in ids.tolist()]).astype(float).T @ some[sums].to_numpy(float)
        if open_ is not None:
            yield done()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:  # whole groups of `replicates` rows, one after the other
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            n = len(held) // replicates
            if n:
                out = held.iloc[np.arange(n) * replicates][groups].reset_index(drop=True)
                for name in names:
                    v = held[name].iloc[:n * replicates].to_numpy(float).reshape(n, replicates)
                    out[f"{name}_low"], out[f"{name}_high"] = percentiles(v, 0.025), percentiles(v, 0.975)
                yield out
                held = held.iloc[n * replicates:]

    fields = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    per = rows.repartition(*groups).sortWithinPartitions(*groups).mapInPandas(draw, ", ".join([fields, *[f"`{s}` double" for s in sums]]))
    per = per.select(*groups, *[e.cast("double").alias(n) for n, e in statistics.items()])
    return per.mapInPandas(ends, ", ".join([fields, *[f"`{n}_{end}` double" for n in statistics for end in ("low", "high")]]))


def percentiles(values: np.ndarray, p: float) -> np.ndarray:
    """Percentile of each row between its two nearest known values, as in SQL; NaN where none is known."""
    known = (~np.isnan(values)).sum(axis=1)
    ordered = np.sort(values, axis=1)  # missing values go last
    at = np.maximum(known - 1, 0) * p
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    each = np.arange(len(values))
    a, b = ordered[each, low], ordered[each, high]
    return np.where(low == high, a, (high - at) * a + (at - low) * b)


def replicate_sums(rows: DataFrame, unit_id: str, sums: list[str], replicates: int, seed: int, groups: list[str]) -> DataFrame:
    """Sums per group and replicate over units that enter each replicate with Poisson(1) copies."""
    rows = rows.select(*groups, F.col(unit_id).cast("bigint").alias("_unit"), *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s)
                                                                                 for s in sums])
    kinds = dict(rows.dtypes)
    numbers = np.arange(replicates, dtype=np.int64)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(groups, dropna=False, sort=False):
                total = np.zeros((replicates, len(sums)))
                for at in range(0, len(part), UNITS_DRAWN):
                    some = part.iloc[at:at + UNITS_DRAWN]
                    u = uniforms(seed, some["_unit"].to_numpy(np.int64)[:, None], numbers[None, :])
                    total += resample_copies(u).T @ some[sums].to_numpy(float)
                out = pd.DataFrame(total, columns=sums)
                for name, value in zip(groups, key):
                    out[name] = value
                yield out.assign(replicate=numbers)[[*groups, "replicate", *sums]]

    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in groups], "replicate bigint", *[f"`{s}` double" for s in sums]])
    return rows.mapInPandas(draw, schema).groupBy(*groups, "replicate").agg(*[F.sum(s).alias(s) for s in sums])


def blocks(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add rows up to the blocks that are resampled together."""
    return df.groupBy(*keys).agg(*[e.alias(n) for n, e in sums.items()])


def null_spread(groups: DataFrame, group_no: str, n: str, wins: str, simulations: int, least: int = 10,
                seed: int = 7) -> DataFrame:
    """Is the range of rates across groups wider than chance? One row with observed range and simulated p.

    The common rate is that of all groups; groups of at least `least` trials are compared. Each simulated world draws a
    binomial count per group by inversion: a group's cumulative probabilities and its draws are put in one order, and a
    draw's count is the number of probabilities up to it. The work is trials plus worlds, never their product. Draws have
    31 bits, so terms that add up to less than 1e-14 at either end are not listed.
    """
    kept = groups.withColumn("_p", groups.agg(ratio(F.sum(wins), F.sum(n))).scalar()).filter(F.col(n) >= least)
    p, size = F.col("_p"), F.col(n).cast("bigint")
    sd = F.sqrt(size * p * (1 - p))
    low = F.greatest(F.lit(0), F.floor(size * p - 9 * sd - 60)).cast("bigint")
    high = F.least(size, F.ceil(size * p + 9 * sd + 60).cast("bigint"))
    k = F.col("_k")
    terms = kept.select(group_no, size.alias("_size"), "_p", low.alias("_low"), F.explode(F.sequence(low, high)).alias("_k"))
    floor = F.lit(1e-300)
    terms = terms.withColumn("_v", F.exp(ln_choose("_size", k) + k * F.ln(F.greatest(p, floor))
                                         + (F.col("_size") - k) * F.ln(F.greatest(1 - p, floor))))
    terms = terms.withColumn("_v", F.sum("_v").over(Window.partitionBy(group_no).orderBy("_k")))
    draws = kept.select(group_no, size.alias("_size"), low.alias("_low"), F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("world"))
    draws = with_uniform(draws, "_v", seed, group_no, "world")
    both = terms.select(group_no, "_size", "_low", "_v", F.lit(None).cast("int").alias("world")).unionByName(
        draws.select(group_no, "_size", "_low", "_v", "world"))
    order = Window.partitionBy(group_no).orderBy("_v", F.col("world").isNotNull())
    upto = F.count_if(F.col("world").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0))
    drawn = both.withColumn("_c", upto).filter("world IS NOT NULL")
    rates = drawn.select("world", (F.least("_size", F.col("_low") + F.col("_c")) / F.col("_size")).alias("_r"))
    ranges = rates.groupBy("world").agg((F.max("_r") - F.min("_r")).alias("_range"))
    rate = ratio(wins, n)
    tested = ranges.withColumn("_seen", kept.agg(F.max(rate) - F.min(rate)).scalar())
    return tested.agg(
        F.max("_seen").alias("observed_range"), F.percentile("_range", F.lit(0.5)).alias("chance_median"),
        F.percentile("_range", F.lit(0.95)).alias("chance_p95"),
        F.avg((F.col("_range") >= F.col("_seen") - 1e-12).cast("double")).alias("p_value"))


def fisher_exact(tables: DataFrame, keys: list[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """Two-sided exact p of 2x2 tables [[a, b], [c, d]], one row per table.

    Terms further than forty standard deviations from the mean add less than 1e-300 and are not listed.
    """
    A, B, C, D = (F.col(x).cast("bigint") for x in (a, b, c, d))
    row, colm, n = A + B, A + C, A + B + C + D
    t = tables.withColumns({"_row": row, "_col": colm, "_n": n, "_a": A})
    mean = ratio(F.col("_row") * F.col("_col"), F.col("_n"))
    sd = F.sqrt(F.greatest(mean, F.lit(1.0)))
    low = F.greatest(F.lit(0), F.col("_row") + F.col("_col") - F.col("_n"), F.floor(mean - 40 * sd - 40))
    high = F.least("_row", "_col", F.ceil(mean + 40 * sd + 40))

    def log_p(k):
        return (ln_choose("_col", k) + ln_choose(F.col("_n") - F.col("_col"), F.col("_row") - k)
                - ln_choose("_n", "_row"))

    # the observed cell is always listed, however far out it lies
    listed = t.withColumn("_k", F.explode(F.array_distinct(F.concat(F.array(A), F.sequence(low.cast("bigint"), high.cast("bigint"))))))
    lk, la = log_p(F.col("_k")), log_p(F.col("_a"))
    return listed.groupBy(*keys, a, b, c, d).agg(
        F.least(F.lit(1.0), F.sum(F.when(lk <= la + 1e-7, F.exp(lk)).otherwise(0.0))).alias("p_value"))


def two_sided_p(z) -> Column:
    return 2 * (1 - normal_cdf(F.abs(F.col(z) if isinstance(z, str) else z)))


def chi_square_tail(x, dof) -> Column:
    """P(X > x) for whole degrees of freedom, in closed form; used for likelihood-ratio tests."""
    x, k = (F.col(v) if isinstance(v, str) else v for v in (x, dof))
    half = F.greatest(x, F.lit(0.0)) / 2
    odd = k % 2 == 1
    first = F.when(odd, two_sided_p(F.sqrt(2 * half))).otherwise(F.lit(0.0))
    steps = F.floor(k / 2).cast("int")  # terms half^a e^-half / gamma(a + 1), a = 0, 1, ... or 1/2, 3/2, ...

    def term(i: Column) -> Column:
        a = i - F.when(odd, 0.5).otherwise(1.0)
        return F.when(half > 0, F.exp(a * F.ln(half) - half - ln_gamma(a + 1))).otherwise(F.when(a == 0, 1.0).otherwise(0.0))

    more = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), F.lit(0.0), lambda s, i: s + term(i)))
    return F.least(F.lit(1.0), first + F.coalesce(more, F.lit(0.0)))


def split_half(df: DataFrame, ident: str, keys: list[str], day: str, tie: str, columns: list[str],
               min_rows: int) -> DataFrame:
    """Correlation of each member's mean over odd and even appearances, and its full-length form."""
    seq = number_rows(df, [*keys, ident], day, tie, "seq")
    halves = seq.groupBy(*keys, ident).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(F.when(F.col("seq") % 2 == h, F.col(c))).alias(f"{c}_{h}") for c in columns for h in (0, 1)])
    kept = halves.filter(F.col("_n") >= min_rows)
    agg = [pearson(f"{c}_0", f"{c}_1", 3).alias(f"r_{c}") for c in columns]
    out = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.avg("_n").alias("rows_per_member"), *agg)
    return out.select("*", *[shrink_half_length(f"r_{c}").alias(f"full_{c}") for c in columns])


def required_pairs(sd, effect: float, alpha_z: float = 1.959964, power_z: float = 0.841621) -> Column:
    """Pairs needed to see a mean difference of `effect` with the given sd."""
    sd = F.col(sd) if isinstance(sd, str) else sd
    return F.ceil(F.pow((alpha_z + power_z) * sd / effect, F.lit(2.0)))


def adjust_false_discovery(df: DataFrame, p: str, out: str = "adjusted") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values from counts of distinct p-values.

    The running minimum goes over value ranges first, then inside each range.
    """
    from touchline.operators.ranking import RANGES, value_counts_ranked

    t = value_counts_ranked(df, [], p).select(
        p, (F.col(p) * F.col("_n") / (F.col("_rank") + (F.col("_c") - 1) / 2.0)).alias("_q"))
    t = t.withColumn("_b", F.floor(F.col(p) * RANGES))
    down = Window.partitionBy("_b").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    tops = t.groupBy("_b").agg(F.min("_q").alias("_m"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_above", F.min("_m").over(above)).drop("_m")
    t = t.join(tops, "_b").withColumn(out, F.least(F.lit(1.0), F.min("_q").over(down), F.col("_above")))
    return df.join(t.select(p, out), p, "left")


def paired_difference(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """Mean, standard error and z of a paired score difference (Diebold-Mariano form at horizon one)."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*groups).agg(F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"),
                                  F.count(d).alias("n"))
    return out.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("z", ratio("mean_diff", "se"))


def ordinal_tables(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Contingency counts of several pairs of ordinal columns in one aggregate: (pair, x, y, n)."""
    rows = F.array(*[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y"))
                     for a, b in pairs])
    return df.select(F.explode(rows).alias("_p")).select("_p.*").groupBy("pair", "x", "y").agg(
        F.count(F.lit(1)).alias("n"))


# Ten-point Gauss-Legendre nodes and weights on [-1, 1] (positive half).
LEGENDRE = ((0.1488743389816312, 0.2955242247147529), (0.4333953941292472, 0.2692667193099963),
            (0.6794095682990244, 0.2190863625159820), (0.8650633666889845, 0.1494513491505806),
            (0.9739065285171717, 0.0666713443086881))


def bivariate_cdf(x, y, r) -> Column:
    """P(X <= x, Y <= y) for correlation r: Phi(x)Phi(y) plus an integral over the correlation angle."""
    top = F.asin(r)
    nodes = F.array(*[F.struct(F.lit(s * t).alias("t"), F.lit(w).alias("w"))
                      for t, w in LEGENDRE for s in (-1, 1)])

    def term(node):
        a = top * (node["t"] + 1) / 2
        c2 = F.greatest(F.cos(a) * F.cos(a), F.lit(1e-12))
        return node["w"] * F.exp(-(x * x + y * y - 2 * x * y * F.sin(a)) / (2 * c2))

    total = F.aggregate(nodes, F.lit(0.0), lambda acc, nd: acc + term(nd))
    return normal_cdf(x) * normal_cdf(y) + top / 2 * total / (2 * math.pi)


def polychoric(tables: DataFrame, rounds: int = 3) -> DataFrame:
    """Maximum-likelihood correlation behind each table of ordinal counts (pair, x, y, n).

    Tables hold a handful of cells each; candidate correlations are rows, refined around the best one.
    """
    def edges(axis):
        w = Window.partitionBy("pair").orderBy(axis)
        marg = tables.groupBy("pair", axis).agg(F.sum("n").alias("m"))
        cum = marg.withColumn("_p", F.sum("m").over(w) / F.sum("m").over(Window.partitionBy("pair")))
        up = F.when(F.col("_p") >= 1, 8.0).otherwise(normal_quantile("_p"))
        cum = cum.withColumn(f"{axis}1", up)
        return cum.withColumn(f"{axis}0", F.coalesce(F.lag(f"{axis}1").over(w), F.lit(-8.0))).select(
            "pair", axis, f"{axis}0", f"{axis}1")

    cells = tables.join(edges("x"), ["pair", "x"]).join(edges("y"), ["pair", "y"])
    step, centre = 0.05, None
    for _ in range(rounds):
        offsets = F.explode(F.array(*[F.lit(k * step) for k in range(-19, 20)])).alias("_o")
        base = cells.withColumn("_mid", F.lit(0.0)) if centre is None else cells.join(centre, "pair")
        g = base.select("*", offsets).withColumn("r", F.greatest(F.lit(-0.999), F.least(
            F.lit(0.999), F.col("_mid") + F.col("_o"))))
        x0, x1, y0, y1, r = (F.col(c) for c in ("x0", "x1", "y0", "y1", "r"))
        p = (bivariate_cdf(x1, y1, r) - bivariate_cdf(x0, y1, r) - bivariate_cdf(x1, y0, r)
             + bivariate_cdf(x0, y0, r))
        ll = g.groupBy("pair", "r").agg(F.sum(F.col("n") * F.ln(F.greatest(p, F.lit(1e-12)))).alias("ll"))
        centre = ll.groupBy("pair").agg(F.max_by("r", F.struct("ll", "r")).alias("_mid"))
        step /= 19
    return centre.withColumnRenamed("_mid", "r")


def variance_explained(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """1 - within-group over total sum of squares, from group sums only."""
    v = F.col(value).cast("double")
    per = df.groupBy(*group).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    return per.filter(F.col("n") > 0).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
                                         (1 - ratio(within, total)).alias("r2"))
