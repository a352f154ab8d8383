"""Chunked windows and range ranks must equal plain ones, also when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import ordered, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 600
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n))
    pdf = pd.DataFrame({"k": key, "id": np.arange(n), "v": rng.integers(0, 9, n).astype(float)})
    pdf["d"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="D")
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("d", F.to_date("d"))
    return pdf, df


def expected(pdf, f):
    s = pdf.sort_values(["d", "id"])
    return f(s.groupby("k")["v"]).reindex(pdf.index)


def got(df, column, pdf):
    return df.select("id", column).toPandas().set_index("id")[column].reindex(pdf["id"]).astype(float)


def test_rolling_with_small_chunks(skewed):
    pdf, df = skewed
    seq = ordered.number_rows(df, ["k"], "d", "id")
    out = ordered.rolling_before(seq, ["k"], "seq", ["v"], 5, 2, chunk=7)
    want = expected(pdf, lambda g: g.transform(lambda s: s.shift(1).rolling(5, min_periods=2).mean()))
    np.testing.assert_allclose(got(out, "v_prev", pdf).values, want.values)
    assert out.count() == len(pdf)


def test_expanding_with_small_chunks(skewed):
    pdf, df = skewed
    seq = ordered.number_rows(df, ["k"], "d", "id")
    out = ordered.expanding_before(seq, ["k"], "seq", ["v"], 3, chunk=11)
    want = expected(pdf, lambda g: g.transform(lambda s: s.shift(1).expanding(min_periods=3).mean()))
    np.testing.assert_allclose(got(out, "v_prev", pdf).values, want.values)


def test_lead_with_small_chunks(skewed):
    pdf, df = skewed
    seq = ordered.number_rows(df, ["k"], "d", "id")
    out = ordered.lead_row(seq, ["k"], "seq", ["id"], chunk=5)
    want = pdf.sort_values(["d", "id"]).groupby("k")["id"].shift(-1).reindex(pdf.index)
    np.testing.assert_allclose(got(out, "id_next", pdf).values, want.values)


def test_gap_starts_a_new_segment(spark):
    df = spark.sql("select 'a' k, 1 id, date'2020-01-01' d union all select 'a', 2, date'2020-01-05' union all select 'a', 3, date'2020-06-01'")
    rows = ordered.number_rows(df, ["k"], "d", "id", max_gap_days=30).orderBy("id").collect()
    assert [(r.segment, r.seq) for r in rows] == [(0, 1), (0, 2), (1, 1)]


def test_top_rows_with_a_hot_key(skewed):
    pdf, df = skewed
    out = ordered.top_rows(df, ["k"], [F.desc_nulls_last("v"), F.asc("id")], 3).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(3)
    assert set(out["id"]) == set(want["id"])


@pytest.mark.parametrize("ranges", [1, 4, 512])
def test_average_rank_in_ranges(skewed, ranges):
    pdf, df = skewed
    t = ranking.value_counts_ranked(df, ["k"], "v", ranges=ranges).toPandas()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).dropna().drop_duplicates(["k", "v"]).set_index(["k", "v"])["r"]
    np.testing.assert_allclose(t.set_index(["k", "v"])["_rank"].sort_index().values, want.sort_index().values)


def test_percentiles_of_eligible_rows(spark):
    df = spark.createDataFrame([("g", i, float(i), 1000.0 if i < 4 else 10.0) for i in (1, 2, 3, 4)], "g string, id int, v double, m double")
    out = ranking.percentile_in_group(df, "v", ["g"], F.col("m") >= 900, "p").orderBy("id").collect()
    assert [None if r.p is None else round(r.p, 1) for r in out] == [33.3, 66.7, 100.0, None]


def test_spearman_and_auc(skewed):
    pdf, df = skewed
    rho = ranking.rank_correlation(df.withColumn("w", F.col("v") * F.col("v") - 6 * F.col("v")), [], "v", "w").first()
    p = pdf.dropna().assign(w=lambda x: x.v ** 2 - 6 * x.v)
    assert rho["rho"] == pytest.approx(p["v"].rank().corr(p["w"].rank()))
    a = ranking.auc(df.filter("v is not null").withColumn("y", F.col("v") >= 5), [], "v", "y").first()
    assert a["auc"] == pytest.approx(1.0)


@pytest.mark.parametrize("minutes,want", [([100] * 11 + [10] * 5, 10), ([50, 30, 20], 2), ([0, 0], 0)])
def test_concentration(spark, minutes, want):
    df = spark.createDataFrame([("t", float(m)) for m in minutes], "t string, m double")
    assert ranking.concentration(df, ["t"], "m").first()["needed"] == want


@pytest.mark.parametrize("plain", [10, 20_000])
def test_ranks_of_heavy_tails(spark, monkeypatch, plain):
    """Ranges cut at quantiles hold like numbers of values however they are spread, and ranks don't depend on them."""
    from touchline.operators import ranking

    monkeypatch.setattr(ranking, "PLAIN", plain)
    rng = np.random.default_rng(5)
    tail = np.exp(4 * rng.normal(size=20_000))
    rows = [("a", float(v)) for v in tail] + [("b", float(v)) for v in rng.integers(0, 9, 500)] + [("c", 7.0)] * 40 + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    counts = df.filter("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("_c"))
    sizes = ranking.value_ranges(counts, ["g"], "v", 64).filter("g = 'a'").groupBy("_b").count().collect()
    if plain == 10:
        assert len(sizes) == 64 and max(r["count"] for r in sizes) < 2 * 20_000 / 64
    else:
        assert len(sizes) == 1
    got = {(r.g, r.v): r.rank for r in ranking.with_average_rank(df, ["g"], "v", "rank").distinct().collect()}
    p = pd.DataFrame(rows, columns=["g", "v"])
    p["rank"] = p.groupby("g")["v"].rank(method="average")
    for g, v, rank in p.dropna().drop_duplicates().itertuples(index=False):
        assert got[g, v] == rank
    assert got["d", None] is None
