"""Probability helpers as column expressions: Poisson, normal, hypergeometric and seeded draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import col

# ln k! for k = 0..60, from the gamma function (the SQL factorial stops at 20).
LN_FACTORIAL = [math.lgamma(k + 1) for k in range(61)]


def ln_factorial_table(top: int = 60) -> Column:
    return F.array(*[F.lit(v) for v in LN_FACTORIAL[: top + 1]])


def ln_gamma(x) -> Column:
    """ln Γ(x), x > 0, by a Stirling series after shifting the argument up by seven."""
    x = col(x).cast("double")
    z = x + 7
    rising = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(rising)


def poisson_pmf(k, lam) -> Column:
    """P(X = k) in log form; a zero mean puts all mass on zero."""
    k, lam = col(k), col(lam).cast("double")
    log_p = -lam + k * F.ln(lam) - ln_gamma(k + 1)
    return F.when(lam > 0, F.exp(log_p)).when(lam == 0, F.when(k == 0, 1.0).otherwise(0.0))


def poisson_terms(lam, top: int) -> Column:
    """Array of P(X = 0..top) for one mean."""
    lam = col(lam).cast("double")
    logs = ln_factorial_table(top)
    return F.transform(
        logs, lambda lf, k: F.exp(-lam + k * F.ln(F.greatest(lam, F.lit(1e-300))) - lf)
    )


def poisson_cdf(k, lam) -> Column:
    """P(X <= floor(k)): the terms from 0 to k, however many."""
    k, lam = F.floor(col(k)).cast("bigint"), col(lam)
    terms = F.sequence(F.lit(0).cast("bigint"), F.greatest(k, F.lit(0)))
    total = F.aggregate(terms, F.lit(0.0), lambda a, j: a + poisson_pmf(j, lam))
    return F.when(k >= 0, total).when(k < 0, 0.0)


def expected_floor(lam, divisor: int, terms: int = 40) -> Column:
    """E[floor(X / divisor)] for X ~ Poisson(lam): points of a 'one per N' rule applied match by match."""
    lam = col(lam).cast("double")
    pmf = poisson_terms(lam, terms - 1)
    weighted = F.transform(pmf, lambda p, k: p * F.floor(k / divisor))
    total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return F.when(lam > 0, total).when(lam.isNotNull(), 0.0)


def blank_probability(nineties, goals) -> Column:
    """Unbiased estimate of exp(-rate) from `goals` over `nineties` matches: ((n-1)/n)^goals."""
    n = F.when(col(nineties) > 0, col(nineties))
    return F.when(n.isNotNull(), F.pow(F.greatest((n - 1) / n, F.lit(0.0)), col(goals)))


PRIME = 2147483647
UPPER = 1103515245  # weight of an integer's multiples of PRIME; numbers from 0 to PRIME - 1 are taken as they are


def with_uniform(df: DataFrame, out: str, seed: int, *parts: str) -> DataFrame:
    """Add a seeded uniform in [0, 1) from integer columns: the same on every engine and every retry of a task.

    A non-linear 31-bit mix per part. Each step is a column of its own because its input is used twice.
    """
    df = df.withColumn("_x", F.lit(seed).cast("bigint"))
    x = F.col("_x")
    for part in parts:
        p = F.col(part).cast("bigint")
        times = F.expr(f"cast(`{part}` as bigint) div {PRIME}") - F.when(p % PRIME < 0, 1).otherwise(0)
        upper = F.pmod(times, F.lit(PRIME)) * UPPER % PRIME
        df = df.withColumn("_x", (x * 31 + F.pmod(p, F.lit(PRIME)) + upper) % PRIME * 1597334677 % PRIME)
        df = df.withColumn("_x", x.bitwiseXOR(F.shiftright(x, 15)) * 747796405 % PRIME)
        df = df.withColumn("_x", x.bitwiseXOR(F.shiftright(x, 13)) * 1274126177 % PRIME)
    return df.withColumn(out, x / float(PRIME)).drop("_x")


# Cumulative Poisson(1) probabilities for 0..12 copies of a resampled unit; more have less than the draws' 31 bits.
COPIES_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]


def uniforms(seed: int, *parts: np.ndarray) -> np.ndarray:
    """The draws of `with_uniform` for arrays of integers, which broadcast against each other."""
    x = np.int64(seed)
    for part in parts:
        upper = part // PRIME % PRIME * UPPER % PRIME
        x = (x * 31 + part % PRIME + upper) % PRIME * 1597334677 % PRIME
        x = (x ^ (x >> 15)) * 747796405 % PRIME
        x = (x ^ (x >> 13)) * 1274126177 % PRIME
    return x / float(PRIME)


def resample_copies(u: np.ndarray) -> np.ndarray:
    """How often a unit enters a bootstrap replicate, from one uniform."""
    return np.searchsorted(COPIES_CDF, u, "right")


def normal_cdf(z) -> Column:
    """Standard normal distribution function (Hart's rational form, about 1e-15)."""
    z = col(z).cast("double")
    a = F.abs(z)
    num = F.lit(3.52624965998911e-02)
    for c in (0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
              221.213596169931, 220.206867912376):
        num = num * a + c
    den = F.lit(8.83883476483184e-02)
    for c in (1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
              637.333633378831, 793.826512519948, 440.413735824752):
        den = den * a + c
    near = F.exp(-a * a / 2) * num / den
    tail = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    far = F.exp(-a * a / 2) / tail / math.sqrt(2 * math.pi)
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def normal_quantile(p) -> Column:
    """Inverse normal by a rational approximation, relative error about 1e-9."""
    p = col(p).cast("double")

    def poly(x, cs):
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * x + c
        return out

    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
         -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
         -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00,
         1.0)
    q = p - 0.5
    ql = F.sqrt(-2 * F.ln(p))
    qh = F.sqrt(-2 * F.ln(1 - p))
    x = (
        F.when(p < 0.02425, poly(ql, c) / poly(ql, d))
        .when(p > 1 - 0.02425, -poly(qh, c) / poly(qh, d))
        .otherwise(q * poly(q * q, a) / poly(q * q, b))
    )
    return F.when((p > 0) & (p < 1), x)


def ln_choose(n, k) -> Column:
    return ln_gamma(col(n) + 1) - ln_gamma(col(k) + 1) - ln_gamma(col(n) - col(k) + 1)
