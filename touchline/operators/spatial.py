"""Where players act and how a team divides the pitch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.functions.numeric import pearson, ratio
from touchline.functions.text import clock_minutes, lookup
from touchline.operators.ordered import lead_row, number_rows
from touchline.operators.ranking import gini
from touchline.session import spread

LENGTH, WIDTH = 120.0, 80.0
# Event types that are an action on the ball.
ACTIONS = ("Pass", "Carry", "Dribble", "Shot", "Ball Recovery", "Interception", "Clearance", "Block", "Duel",
           "Goal Keeper", "Miscontrol", "Dispossessed", "Foul Won")
# Line of each position label.
LINES = {
    "Portero": ("Goalkeeper",),
    "Defensa": ("Right Back", "Left Back", "Center Back", "Right Center Back", "Left Center Back", "Right Wing Back",
                "Left Wing Back"),
    "Medio": ("Center Defensive Midfield", "Right Defensive Midfield", "Left Defensive Midfield", "Center Midfield",
              "Right Center Midfield", "Left Center Midfield", "Center Attacking Midfield",
              "Right Attacking Midfield", "Left Attacking Midfield", "Right Midfield", "Left Midfield"),
    "Ataque": ("Right Wing", "Left Wing", "Center Forward", "Right Center Forward", "Left Center Forward",
               "Secondary Striker"),
}
MODES = ("multiplicative", "additive", "plain")
CELLS = 200  # cells of the raster per side
TILE_CELLS = 20  # cells of a tile per side
SITES_AT_ONCE = 256  # sites whose distances to a tile's cells are held at a time


def line_of(position: str = "position") -> Column:
    return lookup(position, {p: line for line, ps in LINES.items() for p in ps}, "Otro")


def succeeded(df: DataFrame) -> Column:
    """Success rule per event type; for passes and recoveries a missing outcome means success."""
    def c(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def won(name):
        return F.coalesce(c(name).startswith("Won") | c(name).startswith("Success"), F.lit(False))

    t = F.col("type")
    return F.coalesce(
        F.when(t == "Pass", c("pass_outcome").isNull()).when(t.isin("Carry", "Clearance", "Block", "Foul Won"), True)
        .when(t == "Dribble", c("dribble_outcome") == "Complete")
        .when(t == "Shot", c("shot_outcome").isin("Goal", "Saved"))
        .when(t == "Ball Recovery", c("ball_recovery_recovery_failure").isNull())
        .when(t == "Interception", won("interception_outcome")).when(t == "Duel", won("duel_outcome")), F.lit(False))


def starting_elevens(events: DataFrame) -> DataFrame:
    """(match, team, player, formation) from the line-up events."""
    xi = events.filter("type = 'Starting XI' AND tactics IS NOT NULL")
    return xi.select("match_id", "team", F.col("tactics.formation").cast("string").alias("formation"),
                     F.explode("tactics.lineup.player.id").alias("player_id")).withColumn("starter", F.lit(True))


def with_coordinates(events: DataFrame) -> DataFrame:
    return events.withColumns({"x": F.try_element_at("location", F.lit(1)), "y": F.try_element_at("location", F.lit(2))})


def mean_positions(events: DataFrame, min_actions: int = 20, extra: list[str] | None = None) -> DataFrame:
    """One row per player and match: usual position, mean place, spread, actions and success."""
    on_ball = events.filter(F.col("type").isin(*ACTIONS) & F.col("x").isNotNull() & F.col("player").isNotNull())
    on_ball = on_ball.withColumn("_ok", succeeded(events).cast("int"))
    out = on_ball.groupBy("match_id", "team", "player_id", "player").agg(
        F.coalesce(F.mode("position", deterministic=True), F.lit("ND")).alias("position"),
        F.count(F.lit(1)).alias("actions"), F.sum("_ok").alias("successes"), F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.stddev_samp("x").alias("x_sd"), F.stddev_samp("y").alias("y_sd"), F.min("minute").alias("first_minute"),
        F.max("minute").alias("last_minute"), *[F.max(c).alias(c) for c in extra or []])
    return out.filter(F.col("actions") >= min_actions).withColumn("success_pct", 100.0 * F.col("successes") / F.col("actions"))


def additive_weights(points: str, groups: list[str], df: DataFrame, reach: float = 0.15) -> DataFrame:
    """Points as a head start in distance: worst of the group 0, best `reach`."""
    ends = df.groupBy(*groups).agg(F.min(points).alias("_lo"), F.max(points).alias("_hi"))
    w = F.coalesce(reach * ratio(F.col(points) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.join(ends, groups).withColumn("w", w).drop("_lo", "_hi")


def fixed_domain(df: DataFrame, league: list[str], x: str, y: str, margin: float = 1.05) -> DataFrame:
    """Places x, y in the unit square of their league: the same profile lies at the same place in all its seasons."""
    ends = df.groupBy(*league).agg((F.max(x) * margin).alias("_mx"), (F.max(y) * margin).alias("_my"))
    return df.join(ends, league).withColumns({"x": ratio(x, "_mx"), "y": ratio(y, "_my")}).drop("_mx", "_my")


def rejected_weights(sites: DataFrame, mode: str, weight: str) -> DataFrame:
    """Sites that a mode cannot use (non-positive weights when distances are divided)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return sites.filter(F.col(weight).isNull() | (F.col(weight) <= 0)) if mode == "multiplicative" else sites.limit(0)


def _tile_bounds(x: Column, y: Column, box: list[Column], weight: Column | None, mode: str) -> tuple[Column, Column]:
    """Least and greatest weighted distance from a site to the cell centres of a tile."""
    x0, x1, y0, y1 = box
    zero = F.lit(0.0)
    dx, dy = F.greatest(x0 - x, zero, x - x1), F.greatest(y0 - y, zero, y - y1)
    ex, ey = F.greatest(F.abs(x - x0), F.abs(x - x1)), F.greatest(F.abs(y - y0), F.abs(y - y1))
    return tuple(_weighted(F.sqrt(u * u + v * v), weight, mode) for u, v in ((dx, dy), (ex, ey)))


def _weighted(distance: Column, weight: Column | None, mode: str) -> Column:
    return {"multiplicative": lambda: distance / weight, "additive": lambda: distance - weight, "plain": lambda: distance}[mode]()


def owners(sites: DataFrame, group: list[str], site: str, weight: str | None, mode: str = "multiplicative",
           cells: int = CELLS, bounds=((0.0, LENGTH), (0.0, WIDTH)), neighbours: bool = False) -> DataFrame:
    """Owner of every raster cell of every group: the site with the least weighted distance, lowest site on ties.

    The raster is cut into square tiles. Each tile gets the sites that can own a cell in it: those whose least weighted
    distance to the tile is no more than the smallest greatest distance of any site. Bounds combine map-side; rows are
    exchanged by group and tile while they are sites, and become cells after that. With `neighbours` every cell also has the
    owners of its left and lower neighbour (null at the edge), found in the same tile.

    Sites without a place own nothing. In the multiplicative mode a weight that is null, not a number or not positive raises
    an error. Sites at one place with one weight are one, the lowest. Ids may be of any type that has an order.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if weight is None and mode != "plain":
        raise ValueError(f"mode {mode} needs weights")
    (x0, x1), (y0, y1) = bounds
    across, step_x, step_y = -(-cells // TILE_CELLS), (x1 - x0) / cells, (y1 - y0) / cells
    w = F.col(weight).cast("double") if weight else F.lit(0.0)
    if mode == "multiplicative":
        w = F.when(F.coalesce((w > 0) & ~F.isnan(w), F.lit(False)), w).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double"))
    placed = sites.filter("x IS NOT NULL AND y IS NOT NULL").select(*group, F.col(site).alias("_s"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), w.alias("_w"))
    placed = placed.filter("_w IS NOT NULL").groupBy(*group, "_x", "_y", "_w").agg(F.min("_s").alias("_s"))
    tiled = placed.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(across * across - 1))))
    halo = 1 if neighbours else 0  # neighbours reach one cell to the left and down
    box = [low + (edge + 0.5) * step for low, step, n in ((x0, step_x, F.col("_t") % across), (y0, step_y, F.floor(F.col("_t") / across))) for edge in
           (F.greatest(n * TILE_CELLS - halo, F.lit(0)), F.least((n + 1) * TILE_CELLS - 1, F.lit(cells - 1)))]
    low, high = _tile_bounds(F.col("_x"), F.col("_y"), box, F.col("_w"), mode)
    # a struct of the keys is never null; a fixed number of partitions keeps few sites from meeting in one task, where they become many cells
    tiled = spread(tiled.select(F.struct(*group, "_t").alias("_key"), F.struct("_s", "_x", "_y", "_w").alias("_site"), low.alias("_low"), high.alias("_high")), "_key")
    nearest = tiled.groupBy("_key").agg(F.min("_high").alias("_near"))
    # what rounding to nine places can tie is kept
    fit = tiled.join(nearest, "_key").filter(F.col("_low") <= F.col("_near") + 2e-9)
    tiles = fit.groupBy("_key").agg(F.sort_array(F.collect_list("_site")).alias("_sites"))
    first = [(n * TILE_CELLS).cast("int") for n in (F.col("_key._t") % across, F.floor(F.col("_key._t") / across))]
    held = _tile_owners(mode, cells, (x0, y0, step_x, step_y), halo)("_sites._x", "_sites._y", "_sites._w", *first)
    # owners are found per tile, below the step that makes cells of tiles
    raster = tiles.select("_key", "_sites._s", held.alias("_o")).select("_key", "_s", F.inline("_o"))
    names = {"owner": site} | ({"left": "left", "lower": "lower"} if neighbours else {})
    return raster.select(*[F.col("_key")[g].alias(g) for g in group], "cell", *[F.get("_s", F.col(c)).alias(n) for c, n in names.items()])


def _tile_owners(mode: str, cells: int, raster: tuple[float, float, float, float], halo: int):
    """Per tile its cells with the place of each one's owner among the tile's sites, the first of equal ones, and those of the
    cells to the left and below; cells times sites of plain arithmetic, in vectors."""
    x0, y0, step_x, step_y = raster
    kind = pa.struct([("cell", pa.int32()), ("owner", pa.int32()), ("left", pa.int32()), ("lower", pa.int32())])

    def best_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
        cx, cy = x0 + (columns + 0.5) * step_x, y0 + (rows + 0.5) * step_y
        best, owner = np.full((len(rows), len(columns)), np.inf), np.zeros((len(rows), len(columns)), np.int32)
        for at in range(0, len(x), SITES_AT_ONCE):
            part = slice(at, at + SITES_AT_ONCE)
            u, v = cx[None, :, None] - x[part], cy[:, None, None] - y[part]
            d = np.sqrt(u * u + v * v)
            # compared to nine places, so that ties do not hang on the last bit
            d = np.floor((d / w[part] if mode == "multiplicative" else d - w[part] if mode == "additive" else d) * 1e9 + 0.5)
            place = d.argmin(axis=2)
            least = np.take_along_axis(d, place[:, :, None], 2)[:, :, 0]
            owner = np.where(least < best, place + at, owner)
            best = np.minimum(best, least)
        return owner

    @arrow_udf("array<struct<cell: int, owner: int, left: int, lower: int>>")
    def owned(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for begin in range(0, len(batch[0]), 256):
                xs, ys, ws, first, lowest = (c[begin:begin + 256] for c in batch)
                cuts = xs.offsets.to_numpy()
                cuts = cuts - cuts[0]
                x, y, w = (v.flatten().to_numpy(zero_copy_only=False) for v in (xs, ys, ws))
                found = []
                for n, (i, j) in enumerate(zip(first.to_pylist(), lowest.to_pylist())):
                    part = slice(cuts[n], cuts[n + 1])
                    columns, rows = (np.arange(max(e - halo, 0), min(e + TILE_CELLS, cells)) for e in (i, j))
                    owner = best_of(x[part], y[part], w[part], columns, rows)
                    padded = np.pad(owner, ((1, 0), (1, 0)), constant_values=-1)  # -1: no such neighbour
                    inner = np.ix_(np.flatnonzero(rows >= j), np.flatnonzero(columns >= i))
                    cell = rows[:, None] * cells + columns
                    found.append([v[inner].ravel() for v in (cell, owner, padded[1:, :-1], padded[:-1, 1:])])
                ends = np.cumsum([0, *[len(f[0]) for f in found]]).astype(np.int32)
                fields = [np.concatenate(c).astype(np.int32) for c in zip(*found)]
                arrays = [pa.array(c, mask=c < 0) for c in fields]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, fields=list(kind)))

    return owned


def areas(sites: DataFrame, owned: DataFrame, group: list[str], site: str, cells: int = CELLS) -> DataFrame:
    """Share of the raster per site, zero for a site that owns nothing."""
    n = owned.groupBy(*group, site).agg((F.count(F.lit(1)) / float(cells * cells)).alias("area"))
    return sites.join(n, [*group, site], "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def territory(positions: DataFrame, mode: str = "multiplicative", cells: int = CELLS) -> DataFrame:
    """Share of the pitch each player dominates inside his own team and match; weight is successes, at least one."""
    sites = positions.withColumn("w", F.greatest(F.col("successes"), F.lit(1)).cast("double"))
    owned = owners(sites, ["match_id", "team"], "player_id", "w", mode, cells)
    return areas(sites, owned, ["match_id", "team"], "player_id", cells)


def team_sites(positions: DataFrame) -> DataFrame:
    """Starters only, or everyone where no starter is known; weight at least one."""
    any_start = positions.groupBy("match_id", "team").agg(F.max(F.col("starter").cast("int")).alias("_any"))
    return positions.join(any_start, ["match_id", "team"]).filter(
        F.col("starter") | (F.coalesce("_any", F.lit(0)) == 0)).withColumn(
        "w", F.greatest(F.col("successes"), F.lit(1)).cast("double")).drop("_any")


def borders(owned: DataFrame, site: str) -> DataFrame:
    """Cells whose left or lower neighbour belongs to someone else; `owned` has the neighbours' owners."""
    edge = [F.coalesce(F.col(n) != F.col(site), F.lit(False)) for n in ("left", "lower")]
    return owned.withColumn("border", edge[0] | edge[1]).drop("left", "lower")


def apollonius_circle(ax, ay, aw, bx, by, bw) -> tuple[Column, Column, Column]:
    """Centre and radius of the border around the weaker site a (aw < bw)."""
    ax, ay, aw, bx, by, bw = (F.col(c) if isinstance(c, str) else c for c in (ax, ay, aw, bx, by, bw))
    k = aw / bw
    k2 = k * k
    return ((ax - k2 * bx) / (1 - k2), (ay - k2 * by) / (1 - k2),
            k * F.sqrt((ax - bx) ** 2 + (ay - by) ** 2) / (1 - k2))


def team_concentration(areas_: DataFrame) -> DataFrame:
    """Largest cell and Gini of the starters' territory per team and match."""
    d = areas_.filter("starter")
    big = d.groupBy("match_id", "team").agg(F.max("area").alias("largest"))
    return gini(d, ["match_id", "team"], "area").join(big, ["match_id", "team"])


def formations(lineups: DataFrame) -> DataFrame:
    """(match_id, team, formation): starters in defence, midfield and attack, as `4-3-3`, from their position labels."""
    lines = lineups.filter("starter").withColumn("line", line_of())
    counts = [F.count_if(F.col("line") == line) for line in ("Defensa", "Medio", "Ataque")]
    return lines.groupBy("match_id", "team").agg(F.concat_ws("-", *[c.cast("string") for c in counts]).alias("formation"))


def match_points(goals: DataFrame) -> DataFrame:
    """(match_id, team, points) from the goals of the two teams of a match; a match without two teams gives none."""
    both = goals.groupBy("match_id").agg(F.sum("goals").alias("_all"), F.count(F.lit(1)).alias("_teams")).filter("_teams = 2")
    gap = 2 * F.col("goals") - F.col("_all")
    return goals.join(both, "match_id").select("match_id", "team", F.when(gap > 0, 3).when(gap == 0, 1).otherwise(0).alias("points"))


def points_by_quartile(teams: DataFrame, value: str = "gini", points: str = "points") -> DataFrame:
    """Team-matches and mean points per quartile of `value`; 1 is the lowest, an edge belongs to the lower quartile.

    Edges are linear quantiles of the values to six places, so that what Spark counts for them is bounded.
    """
    known = teams.filter(F.col(value).isNotNull()).withColumn("_v", F.round(value, 6))
    edges = known.agg(F.percentile("_v", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("_e"))
    above = F.aggregate("_e", F.lit(1), lambda k, e: k + F.when(F.col("_v") > F.round(e, 9), 1).otherwise(0))
    placed = known.join(F.broadcast(edges)).withColumn("quartile", above)  # one row of three edges
    return placed.groupBy("quartile").agg(F.count(F.lit(1)).alias("matches"), F.avg(points).alias("points"), F.avg("_v").alias(value))


def concentration_by_formation(teams: DataFrame, min_matches: int = 100) -> DataFrame:
    """Mean concentration and largest cell of each formation with at least so many team-matches."""
    return teams.groupBy("formation").agg(F.count(F.lit(1)).alias("matches"), F.avg("gini").alias("gini"),
                                          F.avg("largest").alias("largest")).filter(F.col("matches") >= min_matches)


def concentration_of_teams(teams: DataFrame, keys: list[str], min_matches: int = 30) -> DataFrame:
    """Mean concentration and points per match of every team with at least so many matches."""
    return teams.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.avg("gini").alias("gini"),
                                    F.avg("points").alias("points")).filter(F.col("matches") >= min_matches)


def role_change(areas_: DataFrame, order: str, min_pairs: int = 10) -> DataFrame:
    """Correlation of territory between consecutive starts by how much the role changed, per line and in total."""
    d = areas_.filter("starter").withColumn("line", line_of())
    seq = number_rows(d, ["player_id"], order, "match_id")
    pairs = lead_row(seq, ["player_id"], "seq", ["area", "position", "line"]).filter("area_next IS NOT NULL")
    grade = F.when(F.col("position") == F.col("position_next"), "same_role").when(
        F.col("line") == F.col("line_next"), "same_line").otherwise("changed_line")
    pairs = pairs.withColumn("grade", grade)
    aggs = [F.count(F.lit(1)).alias("pairs")]
    for g in ("same_role", "same_line", "changed_line"):
        here = F.col("grade") == g
        aggs += [F.count_if(here).alias(f"n_{g}"), pearson(F.when(here, F.col("area")), "area_next", min_pairs).alias(f"r_{g}")]
    out = pairs.rollup("line").agg(F.grouping("line").alias("_g"), *aggs)
    return out.withColumn("line", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("line"))).drop("_g")


def minus_group_mean(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    m = df.groupBy(*groups).agg(F.avg(value).alias("_m"))
    return df.join(m, groups).withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def reliability_versions(areas_: DataFrame) -> DataFrame:
    """Territory as is, without its role's mean, without team and line, and without team and role."""
    d = areas_.filter("starter AND area IS NOT NULL").withColumn("line", line_of())
    d = minus_group_mean(d, ["position"], "area", "minus_role")
    d = minus_group_mean(d, ["team", "line"], "area", "minus_team")
    return minus_group_mean(d, ["team", "position"], "area", "minus_team_role")


def pass_network(passes: DataFrame) -> DataFrame:
    """Completed passes per ordered pair with both players' mean places."""
    done = passes.filter("receiver_id IS NOT NULL")
    place = passes.groupBy("match_id", "team", "player_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    pair = done.groupBy("match_id", "team", "player_id", "receiver_id").agg(F.count(F.lit(1)).alias("passes"))
    other = place.select("match_id", "team", F.col("player_id").alias("receiver_id"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    return pair.join(place, ["match_id", "team", "player_id"]).join(other, ["match_id", "team", "receiver_id"])


def density_grid(events: DataFrame, groups: list[str], cols: int = 12, rows: int = 8) -> DataFrame:
    """Actions per grid cell and their share of the group's total."""
    cell = events.withColumns({
        "cx": F.least(F.floor(F.col("x") / (LENGTH / cols)), F.lit(cols - 1)),
        "cy": F.least(F.floor(F.col("y") / (WIDTH / rows)), F.lit(rows - 1))})
    n = cell.groupBy(*groups, "cx", "cy").agg(F.count(F.lit(1)).alias("actions"))
    total = n.groupBy(*groups).agg(F.sum("actions").alias("_t"))
    return n.join(total, groups).withColumn("share", ratio("actions", "_t")).drop("_t")


def smoothed_grid(grid: DataFrame, groups: list[str], cols: int = 12, rows: int = 8, sd: float = 1.0) -> DataFrame:
    """Gaussian smoothing of cell counts: every cell gives weighted parts to its 25 neighbours."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(
        float(2.718281828459045 ** (-(i * i + j * j) / (2 * sd * sd)))).alias("w"))
        for i in range(-2, 3) for j in range(-2, 3)])
    sent = grid.select(*groups, "cx", "cy", "actions", F.explode(offsets).alias("o"))
    sent = sent.select(*groups, (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"),
                       (F.col("actions") * F.col("o.w")).alias("part"))
    inside = sent.filter((F.col("cx") >= 0) & (F.col("cx") < cols) & (F.col("cy") >= 0) & (F.col("cy") < rows))
    return inside.groupBy(*groups, "cx", "cy").agg(F.sum("part").alias("density"))


def dispersion_ellipse(events: DataFrame, groups: list[str], width_sd: float = 2.0) -> DataFrame:
    """Centre and axes of the dispersion ellipse."""
    return events.groupBy(*groups).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), (width_sd * F.stddev_samp("x")).alias("x_axis"),
        (width_sd * F.stddev_samp("y")).alias("y_axis"), F.count(F.lit(1)).alias("actions"))


def minute_bands(events: DataFrame, groups: list[str], value: Column, width: int = 15) -> DataFrame:
    """Value added up per band of minutes."""
    return events.groupBy(*groups, F.floor(F.col("minute") / width).alias("band")).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("events"))


def participation(stints: DataFrame) -> DataFrame:
    """Minutes and state per player and match from stints (from, to, start_reason, end_reason, n).

    Stints are added up, an open one ends with the match, and the match ends at its latest instant, 90 at least.
    """
    s = stints.filter("`from` IS NOT NULL").withColumns({"_a": clock_minutes("from"), "_b": clock_minutes("to")})
    ends = s.groupBy("match_id").agg(F.greatest(F.max("_b"), F.lit(90.0)).alias("_end"))
    s = s.join(ends, "match_id").withColumn("_b", F.coalesce("_b", "_end"))
    out = s.groupBy("match_id", "team", "player_id").agg(
        F.sum(F.col("_b") - F.col("_a")).alias("minutes"), F.min_by("_a", "n").alias("entered"),
        F.max_by("_b", "n").alias("left"), F.count(F.lit(1)).alias("stints"),
        F.max(((F.col("_a") == 0) | F.coalesce(F.col("start_reason").contains("Starting XI"), F.lit(False))).cast("int")).alias("_start"),
        F.max_by("end_reason", "n").alias("exit_reason"))
    why = F.coalesce("exit_reason", F.lit(""))
    state = (F.when(F.col("_start") == 0, "substitute").when(why.contains("Substitution - Off"), "starter_replaced")
             .when(why == "Final Whistle", "starter_full").otherwise("starter_left"))
    return out.withColumn("state", state).drop("_start")


def exits(part: DataFrame) -> DataFrame:
    """Exits by reason with the players involved and how many of them more than once."""
    per = part.groupBy("exit_reason", "player_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("exit_reason").agg(F.sum("n").alias("exits"), F.count(F.lit(1)).alias("players"),
                                          F.count_if(F.col("n") > 1).alias("players_repeating"))


def complete_maps(areas_: DataFrame, starters: int = 11) -> DataFrame:
    """Matches in which both teams show all starters."""
    per = areas_.filter("starter").groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("n"))
    ok = per.groupBy("match_id").agg(F.count(F.lit(1)).alias("teams"), F.min("n").alias("low"))
    return areas_.join(ok.filter((F.col("teams") == 2) & (F.col("low") == starters)).select("match_id"), "match_id", "left_semi")
