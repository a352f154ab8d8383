"""Near-duplicates by shingle similarity against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from touchline.llm import shingle_links, simhash_links
from tests.llm.helpers import prose, smallest


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    return smallest(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def kept(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, f string")
    return sorted(x.doc_id for x in corpus_pipeline.one_near_duplicate(spark, df, "").collect())


@pytest.mark.parametrize("block, tile", [(256, 128), (1, 2), (3, 128)])
def test_stage_finds_edited_copies(spark, monkeypatch, block, tile):
    """Words of long and short texts changed at random places: similarities from below 0.8 to 1, and chains of edits.

    Blocks are read whole, and in tiles smaller and larger than they are."""
    monkeypatch.setattr(shingle_links, "BLOCK_SETS", block)
    monkeypatch.setattr(shingle_links, "TILE", tile)
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    texts = []
    for size in (12, 30, 80, 300, 1500):
        for _ in range(12):
            words = [r.choice(vocabulary) for _ in range(size)]
            texts.append(" ".join(words))
            for _ in range(3):
                for at in r.sample(range(size), max(1, round(size * r.choice((0.005, 0.01, 0.02, 0.03, 0.05))))):
                    words[at] = r.choice(vocabulary)
                texts.append(" ".join(words))
    texts += [None, "", " \n", "one two", "ONE  two", "a b c d e f", prose(r, 40)]
    texts = dict(enumerate(texts))
    assert kept(spark, texts) == sorted(set(brute(texts).values()))


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "q r s t u v")]])
def test_rows_without_keys_repeated_rows_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.text) for x in corpus_pipeline.one_near_duplicate(spark, df, "").collect())
    assert got == ([(-1, "q r s t u v"), (3, "a b c d e f")] if rows else [])


def test_candidates_come_from_simhash(spark, monkeypatch):
    """Without links of fingerprints nothing but equal sets is joined: no other index stands beside them."""
    texts = {1: "a b c d e f g h i j", 2: "a b c d e f g h i j k", 3: "A b c d e f g h i j"}
    assert kept(spark, texts) == [1]
    monkeypatch.setattr(simhash_links, "near_sets", lambda prints: spark.createDataFrame([], "a long, b long"))
    assert kept(spark, texts) == [1, 2]


def test_wide_fingerprints_meet():
    """Bits are majorities; sets at a similarity of 0.8 share a one-wildcard segment and are near enough in the words checked."""
    r = np.random.default_rng(5)
    draw = lambda n: r.integers(0, 2**64, n, np.uint64)
    one = draw(1)
    several = np.concatenate([one, draw(300)])
    bits = [np.unpackbits(simhash_links.wide_fingerprint_of(several[i:i + 1]).view(np.uint8)) for i in range(301)]
    assert (np.unpackbits(simhash_links.wide_fingerprint_of(several).view(np.uint8)) == (2 * np.sum(bits, axis=0, dtype=int) > 301)).all()
    missed = 0
    for shared, x, y in [(8, 1, 1), (12, 0, 3), (80, 10, 10), (400, 0, 100)]:
        for _ in range(200):
            c = draw(shared)
            pair = np.stack([simhash_links.wide_fingerprint_of(np.concatenate([c, draw(n)])) for n in (x, y)])
            half, beside = simhash_links.halves_of(pair)
            rows = pair[np.repeat([0, 1], half.shape[1]), :simhash_links.CHECKED]
            a, b = simhash_links.half_links(half.ravel(), beside.ravel(), rows)
            missed += not (a // half.shape[1] != b // half.shape[1]).any()
    assert missed <= 1


def test_candidate_links_grow_with_a_group(spark):
    """A group of near copies that nearly all meet each other: links grow with its size, not with its pairs, and join the same."""
    r = np.random.default_rng(6)
    count, shared = 400, r.integers(0, 2**64, 90, np.uint64)
    sets = [np.concatenate([r.permutation(shared)[:85], r.integers(0, 2**64, 5, np.uint64)]) for _ in range(count)]
    sets += [r.integers(0, 2**64, 90, np.uint64) for _ in range(20)]
    prints = [(i, simhash_links.wide_fingerprint_of(s).view(np.int64).tolist()) for i, s in enumerate(sets)]
    links = simhash_links.near_sets(spark.createDataFrame([*prints, (-1, [])], "f long, print array<long>")).collect()
    assert len(links) <= 2 * simhash_links.FIRST * count + count
    a, b = (np.array([x[i] for x in links]) for i in (0, 1))
    assert (simhash_links.smallest_joined(a, b, len(sets)) == [*[0] * count, *range(count, len(sets))]).all()


def test_known_joins_change_no_group():
    """Rows joined already are not compared, in buckets compared pair by pair and in searched ones; what is joined is the same."""
    r = np.random.default_rng(7)
    keys = np.sort(r.integers(0, 12, 600))
    prints = r.integers(0, 2**64, (40, 3), np.uint64)[r.integers(0, 40, 600)] ^ (np.uint64(1) << r.integers(0, 64, (600, 3)).astype(np.uint64))
    own = np.arange(600)
    for neighbours in (8, 20, 512):
        a, b = simhash_links.bucket_pairs(keys, prints, 6, neighbours)
        whole = simhash_links.smallest_joined(a, b, 600)
        some = simhash_links.smallest_joined(a[::3], b[::3], 600)
        x, y = simhash_links.bucket_pairs(keys, prints, 6, neighbours, some)
        assert (simhash_links.smallest_joined(np.concatenate([x, own]), np.concatenate([y, some]), 600) == whole).all()
        assert len(np.unique(whole)) < 600 and (whole != some).any()
