"""The SQL surface: the domain views as temporary views, and row rules as SQL functions, for use in `spark.sql`."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from touchline.plans.registry import query
from touchline.plans.views import ctes, raw_panel, view

VIEWS = {"touchline_match": "v_match", "touchline_event": "v_events", "touchline_bet": "v_bets", "touchline_keeper": "v_keepers",
         "touchline_playing_time": "v_playingtime"}
# signature and result -> body
FUNCTIONS = {
    "match_points(scored BIGINT, conceded BIGINT) RETURNS BIGINT":
        "CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 WHEN scored < conceded THEN 0 END",
    "match_outcome(home_goals BIGINT, away_goals BIGINT) RETURNS STRING":
        "CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' WHEN home_goals < away_goals THEN 'A' END",
    "fair_probability(price DOUBLE, second DOUBLE, third DOUBLE) RETURNS DOUBLE":
        "(1 / price) / (1 / price + 1 / second + 1 / third)",
    "per_ninety(amount DOUBLE, minutes DOUBLE) RETURNS DOUBLE": "CASE WHEN minutes > 0 THEN 90 * amount / minutes END",
}


class ScoreCells:
    """Cells of a score grid up to `most` goals a side, of two independent Poisson rates; none for a missing rate."""

    def eval(self, home_rate: float, away_rate: float, most: int) -> Iterator[tuple[int, int, float]]:
        if home_rate is None or away_rate is None or most is None:
            return
        home, away = ([math.exp(-m) * m**k / math.factorial(k) for k in range(most + 1)] for m in (home_rate, away_rate))
        for h, p in enumerate(home):
            for a, q in enumerate(away):
                yield h, a, p * q


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views over the tables in `sf_dir`, and temporary SQL functions: plain expressions that Spark optimises."""
    for name, source in VIEWS.items():
        view(spark, sf_dir, source).createOrReplaceTempView(name)
    raw_panel(spark, sf_dir).createOrReplaceTempView("touchline_panel")
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("score_cells", udtf(ScoreCells, returnType="home_goals int, away_goals int, probability double", useArrow=True))


@query("sql_surface", f"""WITH {ctes('v_match')} SELECT league, season, home AS team, cast(sum(case when hg > ag then 3 when hg = ag then 1 else 0 end) as bigint) AS points,
count_if(hg = ag) AS draws, round(avg((1 / odds_h) / (1 / odds_h + 1 / odds_d + 1 / odds_a)), 6) AS mean_market FROM v_match WHERE played GROUP BY ALL""")
def sql_surface(spark, sf) -> DataFrame:
    register(spark, sf)
    return spark.sql("""
        SELECT league, season, home AS team, sum(match_points(hg, ag)) AS points, count_if(match_outcome(hg, ag) = 'D') AS draws,
               round(avg(fair_probability(odds_h, odds_d, odds_a)), 6) AS mean_market
        FROM touchline_match WHERE played GROUP BY league, season, home""")


@query("sql_panel_rates", f"""WITH {ctes('v_keepers')} SELECT league, season, count(*) AS keepers, round(avg(case when gk_minutes > 0 then 90 * gk_goals_against / gk_minutes end), 6) AS conceded_per_ninety
FROM v_keepers GROUP BY ALL""")
def sql_panel_rates(spark, sf) -> DataFrame:
    register(spark, sf)
    return spark.sql("""
        SELECT league, season, count(*) AS keepers, round(avg(per_ninety(gk_goals_against, gk_minutes)), 6) AS conceded_per_ninety
        FROM touchline_keeper GROUP BY league, season""")


_CELL = "exp(-r) * power(r, k) / gamma(k + 1)"


@query("sql_score_cells", f"""WITH {ctes('v_match')}, k AS (SELECT unnest(range(9)) AS k), m AS (SELECT match_id, league, 0.5 + hst / 4.0 AS lam, 0.5 + ast / 4.0 AS mu FROM v_match WHERE played),
h AS (SELECT match_id, league, k, {_CELL.replace('-r', '-lam').replace('(r,', '(lam,')} AS p FROM m, k), a AS (SELECT match_id, k, {_CELL.replace('-r', '-mu').replace('(r,', '(mu,')} AS q FROM m, k)
SELECT league, count(DISTINCT match_id) AS matches, round(sum(case when h.k + a.k > 2 then p * q else 0 end) / count(DISTINCT match_id), 6) AS over_two,
round(sum(case when h.k > 0 and a.k > 0 then p * q else 0 end) / count(DISTINCT match_id), 6) AS both_score FROM h JOIN a USING (match_id) GROUP BY league""")
def sql_score_cells(spark, sf) -> DataFrame:
    """The table function called laterally for every match: mean chances per league of over two goals and of both scoring."""
    register(spark, sf)
    return spark.sql("""
        WITH per_match AS (
            SELECT m.match_id, m.league, sum(CASE WHEN c.home_goals + c.away_goals > 2 THEN c.probability ELSE 0 END) AS over_two,
                   sum(CASE WHEN c.home_goals > 0 AND c.away_goals > 0 THEN c.probability ELSE 0 END) AS both_score
            FROM touchline_match m, LATERAL score_cells(0.5D + m.hst / 4D, 0.5D + m.ast / 4D, 8) c
            WHERE m.played GROUP BY m.match_id, m.league)
        SELECT league, count(*) AS matches, round(avg(over_two), 6) AS over_two, round(avg(both_score), 6) AS both_score
        FROM per_match GROUP BY league""")
