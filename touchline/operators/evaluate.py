"""Proper scores, calibration and model-versus-market comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import ratio
from touchline.operators.ranking import auc

EVEN_RANGE = 0.125
FLOOR = 1e-12


def outcome(home_goals="hg", away_goals="ag") -> Column:
    h, a = F.col(home_goals), F.col(away_goals)
    return F.when(h > a, "H").when(h < a, "A").when(h == a, "D")


def pick(prefix: str) -> Column:
    """Most likely class; a tie (to nine places) goes to draw, then home, then away."""
    d, h, a = (F.round(f"{prefix}_{k}", 9) for k in ("draw", "home", "away"))
    return F.when((d >= h) & (d >= a), "D").when(h >= a, "H").when(a > h, "A")


def spread(prefix: str) -> Column:
    three = [F.col(f"{prefix}_{k}") for k in ("home", "draw", "away")]
    known = three[0].isNotNull() & three[1].isNotNull() & three[2].isNotNull()
    return F.when(known, F.greatest(*three) - F.least(*three))


def is_even(prefix: str, threshold: float = EVEN_RANGE) -> Column:
    return spread(prefix) <= threshold


def with_scores(df: DataFrame, prefix: str, actual: str = "actual", suffix: str = "") -> DataFrame:
    """Add log-loss, Brier, RPS (home < draw < away) and hit of one set of probabilities."""
    d, h, a = (F.col(f"{prefix}_{k}") for k in ("draw", "home", "away"))
    y = F.col(actual)
    od, oh, oa = ((y == c).cast("double") for c in ("D", "H", "A"))
    p = F.when(y == "D", d).when(y == "H", h).when(y == "A", a)
    known = p.isNotNull()
    return df.withColumns({
        f"logloss{suffix}": F.when(known, -F.ln(F.greatest(p, F.lit(FLOOR)))),
        f"brier{suffix}": (d - od) ** 2 + (h - oh) ** 2 + (a - oa) ** 2,
        f"rps{suffix}": 0.5 * ((h - oh) ** 2 + (h + d - oh - od) ** 2),
        f"hit{suffix}": F.when(known, (pick(prefix) == y).cast("double")),
    })


def on_common_support(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only rows on which every compared forecast exists.

    `needed` names the inputs behind each set of probabilities (expected goals, prices): a filter on them reaches
    the scan, one on the finished probabilities would be evaluated by computing them twice.
    """
    for c in needed:
        df = df.filter(F.col(c).isNotNull())
    return df


def stack_models(df: DataFrame, keep: list[str], prefixes: dict[str, str]) -> DataFrame:
    """One row per match and model, from one pass over the wide frame."""
    rows = F.array(*[F.struct(F.lit(name).alias("model"), *[F.col(f"{p}_{k}").alias(f"q_{k}")
                                                            for k in ("draw", "home", "away")])
                     for name, p in prefixes.items()])
    return df.select(*keep, F.explode(rows).alias("_m")).select(*keep, "_m.*")


def metric_table(stacked: DataFrame, groups: list[str]) -> DataFrame:
    """Scores, draw detection and even-match draw rates per group of a stacked frame (`q_*`, `actual`)."""
    s = with_scores(stacked, "q").withColumn("_even", is_even("q")).withColumn(
        "_draw", (F.col("actual") == "D").cast("int"))
    means = s.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hit_rate"), F.avg("logloss").alias("logloss"),
        F.avg("brier").alias("brier"), F.avg("rps").alias("rps"), F.avg("q_draw").alias("mean_p_draw"),
        F.avg("_draw").alias("draw_rate"), F.sum((pick("q") == "D").cast("int")).alias("draw_picks"),
        F.sum(F.col("_even").cast("int")).alias("even_matches"),
        F.avg(F.when(F.col("_even"), F.col("_draw"))).alias("draws_even"),
        F.avg(F.when(~F.col("_even"), F.col("_draw"))).alias("draws_rest"))
    curve = auc(s.withColumn("_q", F.round("q_draw", 9)), groups, "_q", "_draw").select(*groups, F.col("auc").alias("auc_draw"))
    return means.join(curve, groups)


def baseline_frequencies(df: DataFrame, group: list[str], season: str, actual: str) -> DataFrame:
    """Class frequencies of all earlier seasons, per season."""
    from touchline.operators.ordered import totals_before_day

    counts = {f"_{c}": F.sum((F.col(actual) == c).cast("int")) for c in ("D", "H", "A")}
    before = totals_before_day(df, group, season, counts)
    n = F.col("_D") + F.col("_H") + F.col("_A")
    return before.select(*group, season, n.alias("training"), ratio("_D", n).alias("b_draw"),
                         ratio("_H", n).alias("b_home"), ratio("_A", n).alias("b_away"))


def calibration_bins(df: DataFrame, groups: list[str], probability: str, happened: str, low: float,
                     width: float, bins: int, min_count: int = 50) -> DataFrame:
    """Mean forecast against observed rate per probability bin, sparse bins left out; a forecast of 1 is in the top bin."""
    b = F.floor((F.col(probability) - low) / width)
    if abs(low + width * bins - 1) < 1e-9:
        b = F.when(F.col(probability) >= 1, bins - 1).otherwise(b)
    inside = df.withColumn("bin", b).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    return inside.groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_forecast"),
        F.avg(F.col(happened).cast("double")).alias("observed")).filter(F.col("n") >= min_count)


def expected_calibration_error(df: DataFrame, groups: list[str], probability: str, happened: str,
                               bins: int = 10) -> DataFrame:
    """Bin-size weighted mean gap between forecast and observed rate."""
    table = calibration_bins(df, groups, probability, happened, 0.0, 1.0 / bins, bins, 1)
    gap = F.col("n") * F.abs(F.col("mean_forecast") - F.col("observed"))
    return table.groupBy(*groups).agg(ratio(F.sum(gap), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier_decomposition(df: DataFrame, groups: list[str], probability: str, happened: str,
                        bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty of a binary forecast (Murphy)."""
    table = calibration_bins(df, groups, probability, happened, 0.0, 1.0 / bins, bins, 1)
    n, f, o = F.col("n"), F.col("mean_forecast"), F.col("observed")
    total = F.sum("n")
    base = ratio(F.sum(n * o), total)
    out = table.groupBy(*groups).agg(
        ratio(F.sum(n * (f - o) ** 2), total).alias("reliability"),
        (ratio(F.sum(n * o * o), total) - base * base).alias("resolution"),
        (base * (1 - base)).alias("uncertainty"), total.alias("n"))
    return out


def decision(low, high) -> Column:
    """Pre-registered reading of an interval for model minus market (lower is better)."""
    return F.when(F.col(high) < 0, "model better").when(F.col(low) > 0, "market better").otherwise("no difference")


def temperature_grid(df: DataFrame, prefix: str, actual: str, grid: list[float]) -> DataFrame:
    """Mean log-loss after raising probabilities to 1/T and rescaling, for every T at once."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("temperature")
    rows = df.select(actual, *[f"{prefix}_{k}" for k in ("draw", "home", "away")], t)
    raised = {k: F.pow(F.greatest(F.col(f"{prefix}_{k}"), F.lit(FLOOR)), 1 / F.col("temperature"))
              for k in ("draw", "home", "away")}
    total = raised["draw"] + raised["home"] + raised["away"]
    p = F.when(F.col(actual) == "D", raised["draw"]).when(F.col(actual) == "H", raised["home"]).otherwise(
        raised["away"]) / total
    return rows.groupBy("temperature").agg(F.avg(-F.ln(F.greatest(p, F.lit(FLOOR)))).alias("logloss"),
                                           F.count(F.lit(1)).alias("n"))


def skill(score, reference) -> Column:
    """1 - score / reference: above 0 where a forecast with lower-is-better scores improves on the reference."""
    return 1 - ratio(score, reference)
