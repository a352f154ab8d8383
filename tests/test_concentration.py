"""How teams divide the pitch against what they win: known answers."""

from touchline.operators import spatial


def test_points_need_two_teams(spark):
    goals = spark.createDataFrame([(1, "A", 2), (1, "B", 1), (2, "A", 0), (2, "C", 0), (3, "A", 5)], "match_id long, team string, goals long")
    got = {(x.match_id, x.team): x.points for x in spatial.match_points(goals).collect()}
    assert got == {(1, "A"): 3, (1, "B"): 0, (2, "A"): 1, (2, "C"): 1}


def test_edges_belong_to_the_lower_quartile(spark):
    rows = [(v / 10, p) for v, p in zip((1, 2, 3, 4, 5), (3, 3, 1, 0, 0))] + [(None, 3)]
    got = spatial.points_by_quartile(spark.createDataFrame(rows, "gini double, points int")).collect()
    assert sorted((x.quartile, x.matches, x.points) for x in got) == [(1, 2, 3.0), (2, 1, 1.0), (3, 1, 0.0), (4, 1, 0.0)]


def test_formation_counts_starters_only(spark):
    rows = [(1, "A", True, "Goalkeeper"), (1, "A", True, "Left Back"), (1, "A", True, "Center Midfield"), (1, "A", False, "Left Back"),
            (1, "A", True, "Left Wing"), (1, "A", True, "Right Wing")]
    got = spatial.formations(spark.createDataFrame(rows, "match_id long, team string, starter boolean, position string")).collect()
    assert [x.formation for x in got] == ["1-1-2"]
