"""Winnowing and the comparison with the next document against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.winnowing import as_text, compared_with_next, edited, fingerprints, likeness, rolling_hashes, winnow


def plain(text, k, window):
    codes = np.array([ord(c) for c in text], np.uint64)
    size = min(k, len(codes))
    h = [int(rolling_hashes(codes[i:i + size], size)[0]) for i in range(len(codes) - size + 1)] if len(codes) else []
    width = min(window, len(h))
    places = sorted({max(j for j in range(i, i + width) if h[j] == min(h[i:i + width])) for i in range(len(h) - width + 1)}) if h else []
    return [h[j] for j in places], places


@pytest.mark.parametrize("k,window", [(20, 30), (3, 4), (1, 1), (5, 7)])
def test_rightmost_minima(k, window):
    r = random.Random(k)
    for _ in range(120):
        text = "".join(r.choice("ab") if r.random() < 0.5 else r.choice("abcdé 中") for _ in range(r.randint(0, 150)))
        hashes, places = winnow(text, k, window)
        assert ([int(h) for h in hashes], places.tolist()) == plain(text, k, window)


def test_shared_passages_leave_a_common_hash():
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(20 + 30 - 1))
    for n in range(50):
        a = "".join(r.choice("klmnop") for _ in range(n)) + passage + "zz" * n
        b = "".join(r.choice("qrstuv") for _ in range(3 * n)) + passage
        assert set(winnow(a)[0].tolist()) & set(winnow(b)[0].tolist())


def test_compared_with_next(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abc def\n") for _ in range(r.choice((0, 1, 3, 50, 400)))) for _ in range(90)]
    texts[7], texts[8], texts[40] = None, "", "long " * 9000
    ids = [i * 7 - 100 for i in range(len(texts))]
    rows = list(zip(ids, texts, ["clash"] * len(ids)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, t string").repartition(5)
    got = {x.doc_id: x for x in compared_with_next(df).collect()}
    assert sorted(got) == ids
    for n, (i, text) in enumerate(zip(ids, texts)):
        text, following = text or "", texts[(n + 1) % len(texts)] or ""
        changed = edited(text, following)
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].fingerprint == as_text(winnow(text)[0])
        assert got[i].edited_fingerprint == as_text(winnow(changed)[0])
        assert got[i].near_edited == likeness(winnow(text)[0], winnow(changed)[0])
        assert got[i].near_next == likeness(winnow(text)[0], winnow(following)[0])


def test_single_repeated_null_keys_and_empty(spark):
    one = compared_with_next(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(x.n_chars, x.near_next) for x in one] == [(8, 1.0)]
    some = spark.createDataFrame([(None, "x" * 40), (1, "y" * 40), (1, "y" * 40), (2, "z")], "doc_id long, text string")
    assert sorted(str(x.doc_id) for x in compared_with_next(some).collect()) == ["1", "1", "2", "None"]
    assert compared_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_column(spark):
    rows = spark.createDataFrame([("a" * 100,), (None,), ("",)], "text string").select(fingerprints(F.col("text")).alias("p")).collect()
    assert rows[0].p.positions == winnow("a" * 100)[1].tolist()
    assert rows[1].p.hashes == rows[2].p.hashes == []
