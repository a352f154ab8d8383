"""SimHash fingerprints and links against brute force."""

import random
import re

import numpy as np
import xxhash

from tests.llm.helpers import prose, smallest
from touchline.llm.common import components
from touchline.llm.simhash_links import bucket_links, linked_prints, near_duplicates, one_of_each, variants


def plain_fingerprint(text, n=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_documents_with_nulls_copies_and_ties(spark):
    r = random.Random(1)
    base = prose(r, 300)
    texts = [base, base, base.upper(), base + " extra", base.replace("fox", "dog", 1), None, "", "  \n ", "one two", "ONE  two", "İ é Ä b c",
             prose(r, 5000), "x " * 20_000] + [prose(r, r.randint(1, 80)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, f string, component int")
    rows = {x.doc_id: x for x in near_duplicates(df).collect()}
    want = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: x.fingerprint % 2**64 for i, x in rows.items()} == want
    low = smallest(want, lambda a, b: bin(want[a] ^ want[b]).count("1") <= 4)
    assert {i: x.component for i, x in rows.items()} == low
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(low.values()))


def test_dense_and_scattered_prints(spark):
    r = random.Random(2)
    centre = [r.getrandbits(64) for _ in range(6)]
    prints = set(centre)
    for c in centre:
        for _ in range(120):
            x = c
            for _ in range(r.randint(1, 6)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints |= {r.getrandbits(64) for _ in range(200)}
    signed = [x - (x >> 63 << 64) for x in prints]
    got = {x.node: x.component for x in linked_prints(spark.createDataFrame([(x,) for x in signed], "f long"), 4).collect()}
    low = smallest(signed, lambda a, b: bin((a ^ b) % 2**64).count("1") <= 4)
    assert {x: got.get(x, x) for x in signed} == low


def test_variants_meet_within_the_limit(spark):
    r = random.Random(3)
    x = r.getrandbits(63)
    for bits in (1, 2, 3, 4, 6):
        y = x
        for b in r.sample(range(63), bits):
            y ^= 1 << b
        keys = variants(spark.createDataFrame([(x,), (y,)], "f long"), bits)
        assert keys.count() == 128
        assert keys.groupBy("key").count().where("count > 1").count() >= 1


def test_buckets_join_what_their_pairs_join():
    r = random.Random(8)
    for size in (1, 2, 5, 9, 10, 40, 200):
        members = {r.getrandbits(16) for _ in range(size)}
        prints = np.array(sorted(members), np.uint64)
        a, b = bucket_links(np.repeat(np.int64(7), len(prints)), prints, 4)
        links = {(int(x), int(y)) for x, y in zip(a, b)}
        near = {(x, y) for x in members for y in members if bin(x ^ y).count("1") <= 4}
        assert links <= near
        assert smallest(members, lambda x, y: (x, y) in links or (y, x) in links) == smallest(members, lambda x, y: (x, y) in near)
        if size > 9:
            assert len(links) < len(members)


def test_rows_without_keys_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "q r s t u")],
                               "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.component or -1) for x in near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 3), (-1, 3), (3, 3), (3, 3)]
    assert sorted((x.doc_id or -1, x.text) for x in one_of_each(df).collect()) == [(-1, "q r s t u"), (3, "a b c d e")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    assert one_of_each(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2001, 2000), (2001, 2000)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61))
    assert all(got[1000 + i] == 1000 for i in range(1, 300))
    assert got[2001] == 2000
