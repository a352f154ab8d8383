"""Toxicity models: what they learn, held-out accuracy and odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import prose
from touchline.llm import toxicity
from touchline.llm.queries import TOXIC_FROM

INSULTS = ("grobnik", "snurfel", "plonkwit")


def corpus(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(r, r.choice((8, 30, 120))).split()
        toxic = r.random() < 0.3
        for at in range(0, len(words), 15) if toxic else ():
            words.insert(at, r.choice(INSULTS))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_word_numbers_follow_texts():
    numbers, offsets = toxicity.word_numbers(pa.array(["One two, TWO", None, "", "one"]))
    assert offsets.tolist() == [0, 3, 3, 3, 4]
    assert numbers[0] == numbers[3] and numbers[1] == numbers[2] != numbers[0]
    assert toxicity.pairs(numbers, offsets)[3] >> toxicity.WORD_BITS == 0
    assert toxicity.word_numbers(pa.array([], pa.string()))[1].tolist() == [0]


def test_unknown_words_say_nothing():
    counts = np.zeros((2, 50))
    counts[0, :20], counts[1, 10:30] = 40, 9
    lower = toxicity.lower_orders(counts)
    assert np.allclose(lower[0, 40:], lower[1, 40:])
    assert lower[1, 25] > 5 * lower[0, 25] and lower[0, 5] > 5 * lower[1, 5]


def test_held_out_accuracy(spark):
    rows = corpus(3000)
    documents = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents, labels)
    got = documents.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("out"), toxicity.score(spark, model, F.col("text")).alias("s")).collect()
    truth = {i: y for i, _, y in rows}
    assert all(x.out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert all(0 <= x.s <= 1 for x in got)
    wrong = [x for x in got if x.out and (x.s >= TOXIC_FROM) != truth[x.doc_id]]
    assert len(wrong) < 0.02 * len(rows)


def test_held_out_labels_are_not_learnt(spark):
    rows = corpus(800, 1)
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    scores = []
    for labels in ([(i, y) for i, _, y in rows], flipped):
        model = toxicity.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores.append(model.scores(pa.array([t for _, t, _ in rows])))
    assert np.array_equal(*scores)


def test_missing_classes_null_empty_and_long_texts(spark):
    documents = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 60_000), (None, "x y"), (4, "?!")], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, None)], [(3, 1)]):
        model = toxicity.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = documents.select(toxicity.score(spark, model, F.col("text")).alias("s")).collect()
        assert len(scores) == 5 and all(0 <= x.s <= 1 for x in scores)
    fitted = toxicity.fit(spark.createDataFrame([(i, t) for i, t, _ in corpus(400, 2)], "doc_id long, text string"),
                          spark.createDataFrame([(i, y) for i, _, y in corpus(400, 2)], "doc_id long, toxic int"))
    assert np.isfinite(fitted.scores(pa.array([None, "", "w " * 60_000, "??"]))).all()
    assert not spark.createDataFrame([], "text string").select(toxicity.score(spark, fitted, F.col("text"))).collect()


def test_no_two_words_or_pairs_share_a_key():
    """More words than 2^18, and more pairs than 2^20."""
    numbers, offsets = toxicity.word_numbers(pa.array([" ".join(chr(97 + i // 26**4 % 26) + chr(97 + i // 26**3 % 26) + chr(97 + i // 676 % 26)
                                                                + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(1_200_000))]))
    assert len(np.unique(numbers)) == 1_200_000
    assert len(np.unique(np.concatenate([toxicity.pairs(numbers, offsets), ~numbers]))) == 2_400_000


def test_joined_model_scores_as_the_sent_one(spark, monkeypatch):
    rows = corpus(600, 3) + [(9000, None, 0), (9001, "", 0), (9002, "?!", 0), (9003, "w " * 5000, 0)]
    rows += [(9100 + i, rows[i][1], rows[i][2]) for i in range(20)]
    documents = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, h1 string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sent = toxicity.fit(documents, labels)
    want = {i: s for (i, _, _), s in zip(rows, sent.scores(pa.array([t for _, t, _ in rows])))}
    monkeypatch.setattr(toxicity, "SENT_KEYS", 0)
    joined = toxicity.fit(documents, labels)
    assert sent.sent is not None and joined.sent is None
    got = {x.doc_id: x.s for x in toxicity.with_score(documents, joined, "s").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)
