"""Hard negatives against a plain pass over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import anchor_trees
from touchline.llm.anchor_trees import LONG, Tree, hard_negatives, spanning_tree


def plain(rows, every, positives=5, negatives=3, low=50, high=95, scale=256):
    held = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) or not math.isfinite(v * scale) for v in x):
            continue
        held.append((i, label, [max(-LONG - 1, min(LONG, math.floor(v * scale))) for v in x]))
    anchors = {}
    for r in held:
        if r[0] % every == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r)
    out = []
    for i, label, q in anchors.values():
        scored = [(-max(-LONG, min(LONG, sum(a * b for a, b in zip(q, y)))), j, m) for j, m, y in held]
        near = sorted((s, j) for s, j, m in scored if m == label and j != i)[:positives]
        for s, j in near:
            far = sorted((t, k) for t, k, m in scored if m != label and -low * s <= -100 * t <= -high * s)[:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(far)]
    return sorted(out)


def given(spark, rows, every=10, **more):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<double>, anchor string")
    return sorted(tuple(x) for x in hard_negatives(df.repartition(3), F.col("vec_id") % every == 0, **more).collect())


def near_rows(n, dims, labels, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, dims)) + 1.0
    out = []
    for i in range(n):
        label = int(r.integers(labels))
        v = centres[label] + r.normal(size=dims) * 0.5
        out.append((i, label, (v / np.linalg.norm(v)).tolist()))
    return out


def test_tree_spans_with_parents_first():
    r = np.random.default_rng(2)
    v = r.normal(size=(60, 5))
    order, parent, edge = spanning_tree(v)
    assert sorted(order) == list(range(60)) and parent[0] == -1 and (parent[1:] >= 0).all()
    assert all(p < i for i, p in enumerate(parent))
    assert np.allclose(edge[1:], np.linalg.norm(v[order[1:]] - v[order[parent[1:]]], axis=1))
    # Kruskal's total
    pairs = sorted((np.linalg.norm(v[i] - v[j]), i, j) for i in range(60) for j in range(i))
    root, total = list(range(60)), 0.0
    for d, i, j in pairs:
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[i], total = j, total + d
    assert abs(total - edge.sum()) < 1e-9


def test_bounds_spare_most_scores_of_near_anchors():
    r = np.random.default_rng(4)
    x = np.floor(256 * r.normal(size=(4000, 16)) / 4)
    a = x[:1] + np.floor(r.normal(size=(50, 16)))
    order, parent, edge = spanning_tree(a)
    tree = Tree(np.arange(50) - 50, np.zeros(50, int), a[order], parent, edge, np.full((50, 1), 60_000.0), np.full((50, 1), 70_000.0), False, 3)
    tree.read(np.arange(4000), np.ones(4000, int), x)
    assert tree.scored < 0.2 * 50 * 4000
    for anchor, (scores, ids) in zip(a[order], [b[0] for b in tree.best]):
        s = x @ anchor
        want = sorted((-v, i) for i, v in enumerate(s) if 60_000 <= v <= 70_000)[:3]
        assert [(-int(v), int(i)) for v, i in zip(scores, ids)] == want


@pytest.mark.parametrize("group,tile", [(512, 4096), (4, 32)])
def test_equals_a_plain_pass(spark, monkeypatch, group, tile):
    monkeypatch.setattr(anchor_trees, "GROUP", group)
    monkeypatch.setattr(anchor_trees, "TILE", tile)
    rows = near_rows(500, 8, 4, 7)
    want = plain(rows, 10)
    assert len(want) > 100
    assert given(spark, rows) == want


def test_hard_rows(spark):
    r = random.Random(5)
    rows = [(i, r.choice((1, 2, 3)), [r.choice((0.0, 0.25, 0.5, 1.0)) for _ in range(4)]) for i in range(120)]
    rows += [(200, None, [1.0] * 4), (210, 1, None), (220, 1, [1.0, None, 1.0, 1.0]), (230, 2, [float("nan")] * 4), (240, 2, [float("inf")] * 4),
             (None, 1, [1.0] * 4), (250, 1, []), (260, 2, [1.0]), (270, 2, [-0.5] * 4), (280, 3, [0.0] * 4), (290, 1, [1e308] * 4)]
    rows += [(300 + i, 1 + i % 2, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # copies: ties go by key
    rows += [rows[0], rows[7], (10, 3, [0.25] * 4)]  # repeated rows, a repeated key
    assert given(spark, rows) == plain(rows, 10)


def test_large_numbers_stay_exact(spark):
    r = random.Random(6)
    rows = [(i, i % 3, [r.uniform(0.9, 1.1) * 10**r.choice((3, 6)) for _ in range(3)]) for i in range(60)]
    assert given(spark, rows) == plain(rows, 10)
    rows += [(100 + i, i % 3, [r.uniform(0.9, 1.1) * 10**r.choice((9, 12)) for _ in range(3)]) for i in range(30)]
    assert given(spark, rows) == plain(rows, 10)


def test_empty_and_other_kinds(spark):
    assert given(spark, []) == []
    assert given(spark, [(10, 1, [1.0])]) == []
    assert given(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    bad = spark.createDataFrame([("a", 1, [1.0])], "vec_id string, label int, embedding array<double>")
    with pytest.raises(TypeError):
        hard_negatives(bad, F.lit(True))
