"""Vector links by bounds against plain cosines."""

import random

import numpy as np
import pytest

from tests.llm.helpers import smallest
from touchline.llm import quantised_links
from touchline.llm.quantised_links import linked, near_vectors, quantise


def test_bounds_hold():
    g = np.random.default_rng(1)
    a, b = g.normal(size=(300, 64)), g.normal(size=(200, 64))
    b[:100] = a[:100] + g.normal(size=(100, 64)) * 0.19
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    true = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert (np.abs(qa @ qb.T * sa[:, None] * sb - true) <= ea[:, None] * (1 + eb) + eb).all()
    for threshold in (0.5, 0.95, 0.98):
        assert (linked(a, b, threshold) == (true >= threshold)).all()


@pytest.mark.parametrize("tile", [1024, 16])
def test_equals_plain_cosines(spark, monkeypatch, tile):
    monkeypatch.setattr(quantised_links, "TILE", tile)
    r, g = random.Random(2), np.random.default_rng(2)
    vectors = [g.normal(size=16) for _ in range(40)]
    for i in range(80):
        vectors.append(vectors[r.randrange(len(vectors))] + g.normal(size=16) * r.choice((0, 0.05, 0.18, 0.3)))
    rows = [(i, [float(np.float32(v)) for v in x], i % 2, "clash") for i, x in enumerate(vectors)]
    special = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(1000 + i, x, 0, "clash") for i, x in enumerate(special)]
    rows += [(2000, rows[0][1], None, "clash"), (2001, rows[0][1], 0, "clash"), (2002, [1e-30 * v for v in rows[0][1]], 0, "clash")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long".replace("n long", "node string"))
    got = {x.vec_id: x for x in near_vectors(df).collect()}
    assert len(got) == len(rows)
    by_id = {i: (x, y) for i, x, y, _ in rows}

    def sound(i):
        x, y = by_id[i]
        return y is not None and bool(x) and all(v is not None and np.isfinite(v) for v in x) and any(np.float32(v) for v in x)

    def link(i, j):
        (x, a), (y, b) = by_id[i], by_id[j]
        if i == j or not sound(i) or not sound(j) or a != b or len(x) != len(y):
            return False
        x, y = np.float32(x).astype(float), np.float32(y).astype(float)
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    low = smallest(by_id, link)
    assert {i: x.n_links for i, x in got.items()} == {i: sum(link(i, j) for j in by_id) for i in by_id}
    assert {i: x.component for i, x in got.items()} == low
    assert all(x.kept == (x.vec_id == x.component) for x in got.values())


def test_empty_and_null_keys(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], schema)).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.component, x.kept) for x in rows) == [(0, 0, None, False), (1, 1, 1, True), (1, 1, 1, True)]
