"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.periodic_runs import greatest, kept_words, periodic_runs, runs_of, with_planted_period, word_names


def plain(w, times=4, least=6):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            seg = w[start:start + length]
            if length > q and length >= max(least, times * q) and not any(seg[d:] == seg[:-d] for d in range(1, q)):
                out.append((start, length, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(r):
    letters = "abcd"[: r.choice((1, 2, 2, 3, 4))]
    w = [r.choice(letters) for _ in range(r.randint(0, 50))]
    if r.random() < 0.6:
        unit = [r.choice(letters) for _ in range(r.randint(1, 9))]
        w += (unit * 9)[: r.randint(0, 70)] + w[:5]
    return w


def test_runs_equal_a_plain_search():
    r = random.Random(1)
    for _ in range(1200):
        w = some_words(r)
        names = word_names([x.encode() for x in w])
        for times in (4, 3):
            assert [tuple(x) for x in runs_of(names, times).tolist()] == plain(w, times), w
    with pytest.raises(ValueError):
        runs_of(np.zeros(9, np.int64), times=2)


def test_greatest_takes_the_first_of_equal_ratios():
    assert greatest(np.array([[0, 8, 2], [3, 12, 3], [9, 4, 1]])) == 0
    assert greatest(np.array([[0, 8, 2], [3, 13, 3]])) == 1
    assert greatest(np.zeros((0, 3), np.int64)) is None


def test_long_texts_stay_fast():
    n = 400_000
    began = time.time()
    for period in (1, 7, n // 5):
        assert runs_of(np.arange(n) % period).tolist() == [[0, n, period]]
    assert len(runs_of(np.random.default_rng(1).integers(0, 3, n))) > 1000
    assert time.time() - began < 20


def test_column_with_hard_rows(spark):
    texts = [None, "", " \t\n", "a", "x " * 6, "x " * 5, "a b a b a b a b c", "é é " * 8, "A a " * 9, "w" * 300_000,
             "so it goes " * 20_000, "x " * 6, "l1\nl2\r\nl1\x0bl2\x0cl1 l2 l1 l2"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = {x.doc_id: x.f for x in df.select("doc_id", periodic_runs(F.col("text")).alias("f")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        f = got[i]
        assert f.n_words == len(w)
        if len(w) < 100:
            rows = plain(w)
            assert [(x.start, x.length, x.period) for x in f.runs] == rows
            kept = kept_words(len(w), np.array(rows, np.int64).reshape(-1, 3))
            assert f.collapsed.encode() == b" ".join(x for x, k in zip(w, kept) if k)
    assert got[10].collapsed == "so it goes" and got[10].runs[0].length == 60_000
    empty = spark.createDataFrame([], "doc_id long, text string").select(periodic_runs(F.col("text")).alias("f"))
    assert empty.count() == 0


def test_planted_period(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(-50, 400)] + [(None, "a b"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", with_planted_period(F.col("text"), F.col("doc_id")).alias("t")).collect()
    changed = 0
    for x in got:
        h = zlib.crc32(str(x.doc_id).encode()) if x.doc_id is not None else 1
        w = (x.text or "").split()
        want = x.text
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
            changed += 1
        assert x.t == want
    assert changed > 20


def test_query_against_plain_python(spark):
    from touchline.llm.queries import op12_periodic_runs

    sf = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_periodic_runs(spark, sf).collect()
    assert len(rows) == len(texts)
    checked = 0
    for x in rows:
        h, w = zlib.crc32(str(x.doc_id).encode()), texts[x.doc_id].encode().split()
        if len(w) > 400:
            continue
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain(w)
        checked += bool(runs)
        assert x.n_runs == len(runs)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert x.collapsed_sha256 == hashlib.sha256(b" ".join(v for i, v in enumerate(w) if i not in gone)).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            assert (x.start, x.length, x.period, x.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (x.start, x.length, x.period, x.exponent_milli) == (None,) * 4
    assert checked > 5
