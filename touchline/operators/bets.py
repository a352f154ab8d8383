"""Settlement, model probability, combination and return of bets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.numeric import ratio
from touchline.functions.probability import poisson_cdf
from touchline.operators.scoreline import SIDE, grid_sum, score_grid

# Selections of a double chance and the results each covers.
DOUBLE = {"1X": ("Local", "Empate"), "X2": ("Empate", "Visitante"), "12": ("Local", "Visitante")}
TOTALS = {"over_under_goles": "goals", "tarjetas_over_under": "cards", "corners_over_under": "corners"}
KINDS = ["1x2", "doble_oportunidad", *TOTALS, "ambos_anotan", "handicap", "marcador_exacto", "otro"]
WON, LOST, PUSH, OPEN, UNGRADED = "gano", "perdio", "push", "pendiente", "no calificable"


def _won(condition: Column) -> Column:
    return F.when(condition, WON).otherwise(LOST)


def _yes(selection: Column) -> Column:
    return F.lower(selection).isin("si", "sí")


def settle_legs(legs: DataFrame) -> DataFrame:
    """State of each leg from the final score, total cards and corners; unknown results stay open.

    Expects kind, selection, line, hg, ag, cards, corners.
    """
    gl, gv, line, sel = (F.col(c) for c in ("hg", "ag", "line", "selection"))
    kind = F.col("kind")
    real = F.when(gl > gv, "Local").when(gl < gv, "Visitante").otherwise("Empate")
    double = F.lit(UNGRADED)
    for key, covered in DOUBLE.items():
        double = F.when(F.upper(sel) == key, _won(real.isin(*covered))).otherwise(double)
    total = F.when(kind == "over_under_goles", gl + gv).when(kind == "tarjetas_over_under", F.col("cards")).when(
        kind == "corners_over_under", F.col("corners"))
    over = (F.when(total.isNull() | line.isNull(), UNGRADED).when(total == line, PUSH)
            .otherwise(_won((total > line) == (F.lower(sel) == "over"))))
    half = F.abs(F.pmod(line * 2, F.lit(2.0)) - 1) <= 1e-9
    handicap = (F.when(line.isNull() | ~half, UNGRADED).when(sel == "Local", _won(gl + line > gv))
                .when(sel == "Visitante", _won(gv + line > gl)).otherwise(UNGRADED))
    exact = _won(F.regexp_replace(sel, " ", "") == F.concat_ws("-", gl.cast("int"), gv.cast("int")))
    state = (F.when(gl.isNull() | gv.isNull(), OPEN).when(kind == "1x2", _won(sel == real))
             .when(kind == "doble_oportunidad", double).when(kind.isin(*TOTALS), over)
             .when(kind == "ambos_anotan", _won(((gl > 0) & (gv > 0)) == _yes(sel)))
             .when(kind == "handicap", handicap).when(kind == "marcador_exacto", exact).otherwise(UNGRADED))
    return legs.withColumn("state", state)


def model_probability(legs: DataFrame, rho) -> DataFrame:
    """Model probability of each leg: from 1X2, the score grid or a Poisson of cards; NULL where no model covers it.

    Expects p_home, p_draw, p_away, lam, mu, expected_cards.
    """
    kind, sel, line = F.col("kind"), F.col("selection"), F.col("line")
    h, d, a = F.col("p_home"), F.col("p_draw"), F.col("p_away")
    goals = kind.isin("over_under_goles", "ambos_anotan", "handicap", "marcador_exacto")
    legs = legs.withColumn("_grid", F.when(goals & F.col("lam").isNotNull() & F.col("mu").isNotNull(),
                                           score_grid("lam", "mu", rho)))
    single = F.when(sel == "Local", h).when(sel == "Empate", d).when(sel == "Visitante", a)
    double = F.when(F.upper(sel) == "1X", h + d).when(F.upper(sel) == "X2", d + a).when(F.upper(sel) == "12", h + a)
    over = grid_sum("_grid", lambda i, j: i + j > line)
    both = grid_sum("_grid", lambda i, j: (i > 0) & (j > 0))
    handicap = F.when(sel == "Local", grid_sum("_grid", lambda i, j: i + line > j)).otherwise(
        grid_sum("_grid", lambda i, j: j + line > i))
    score = F.regexp_replace(sel, " ", "")
    hi = F.regexp_extract(score, "^(\\d+)-(\\d+)$", 1).try_cast("int")
    ai = F.regexp_extract(score, "^(\\d+)-(\\d+)$", 2).try_cast("int")
    inside = (hi <= SIDE - 1) & (ai <= SIDE - 1)
    exact = F.when(inside, F.element_at("_grid", hi * SIDE + ai + 1)
                   / F.aggregate("_grid", F.lit(0.0), lambda x, y: x + y))
    cards = 1 - poisson_cdf(F.floor(line), "expected_cards")

    def side(p):
        return F.when(F.lower(sel) == "over", p).otherwise(1 - p)

    p = (F.when(kind == "1x2", single).when(kind == "doble_oportunidad", double)
         .when((kind == "tarjetas_over_under") & line.isNotNull() & F.col("expected_cards").isNotNull(), side(cards))
         .when((kind == "over_under_goles") & line.isNotNull(), side(over))
         .when(kind == "ambos_anotan", F.when(_yes(sel), both).otherwise(1 - both))
         .when((kind == "handicap") & line.isNotNull(), handicap).when(kind == "marcador_exacto", exact))
    return legs.withColumn("p_model", p).drop("_grid")


def with_edge(legs: DataFrame) -> DataFrame:
    """Implied probability of the price and the model's edge over it; agreement with the model's pick for 1X2."""
    implied = F.when(F.col("odds") > 0, 1 / F.col("odds"))
    return legs.withColumns({
        "p_implied": implied, "edge": F.col("p_model") - implied,
        "agrees": F.when(F.col("kind") == "1x2", F.col("selection") == F.col("model_pick"))})


def combine(legs: DataFrame) -> DataFrame:
    """One row per bet: singles as they are, legs of a combination together.

    One lost leg loses it, pushes drop out, an open or ungraded leg leaves it so, prices multiply.
    """
    unit = F.coalesce("combo_id", F.concat(F.lit("S"), F.col("bet_id").cast("string")))
    state = F.col("state")
    g = legs.withColumn("unit", unit).groupBy("unit").agg(
        F.min("match_date").alias("match_date"), F.count(F.lit(1)).alias("legs"),
        F.count_if(state == LOST).alias("_lost"), F.count_if(state == OPEN).alias("_open"),
        F.count_if(state == UNGRADED).alias("_un"), F.count_if(state == PUSH).alias("_push"),
        F.max(F.col("combo_id").isNotNull()).alias("_combo"),
        F.exp(F.sum(F.when(state != PUSH, F.ln("odds")))).alias("_product"), F.max("odds").alias("_odds"),
        F.max("stake").alias("stake"), F.max(F.when(F.col("combo_id").isNull(), F.col("kind"))).alias("_kind"),
        F.max(F.when(F.col("combo_id").isNull(), F.col("edge"))).alias("edge"), F.max("league").alias("league"))
    combined = (F.when(F.col("_lost") > 0, LOST).when(F.col("_open") > 0, OPEN).when(F.col("_un") > 0, UNGRADED)
                .otherwise(WON))
    single = (F.when(F.col("_push") > 0, PUSH).otherwise(combined))
    return g.select(
        "unit", "match_date", "league", "legs", F.when(F.col("_combo"), "combinada").otherwise(F.col("_kind")).alias("kind"),
        F.when(F.col("_combo"), combined).otherwise(single).alias("state"),
        F.when(F.col("_combo"), F.coalesce("_product", F.lit(1.0))).otherwise(F.col("_odds")).alias("odds"), "stake", "edge")


def with_profit(bets: DataFrame) -> DataFrame:
    settled = F.col("state").isin(WON, LOST)
    gain = F.when(F.col("state") == WON, F.col("stake") * (F.col("odds") - 1)).otherwise(-F.col("stake"))
    return bets.withColumns({"settled": settled, "profit": F.when(settled & F.col("odds").isNotNull(), gain)})


def returns_by_slice(bets: DataFrame, slices: dict[str, Column], small: int = 30) -> DataFrame:
    """Hit rate, implied probability, profit and return for every value of every slice, in one pass over the bets."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("string").alias("value"))
                                for n, c in slices.items()])).alias("_c")
    rows = with_profit(bets).filter("settled").select("state", "odds", "profit", "stake", cells)
    return rows.groupBy("_c.slice", "_c.value").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("state") == WON).cast("double")).alias("hit_rate"),
        F.avg(1 / F.col("odds")).alias("mean_implied"), F.sum("profit").alias("profit"),
        F.sum(F.when(F.col("profit").isNotNull(), F.col("stake"))).alias("staked")).withColumns({
            "roi": ratio("profit", "staked"), "noise": F.col("n") < small})


def value_and_fraction(p, odds) -> tuple[Column, Column]:
    """Expected value per unit and the growth-optimal fraction (zero when there is no edge)."""
    p, odds = (F.col(c) if isinstance(c, str) else c for c in (p, odds))
    ev = p * odds - 1
    return ev, F.greatest(F.lit(0.0), ratio(ev, odds - 1))
