"""Byte-level BPE against the rank library, and round trips."""

import base64
import random

import public_tokenizers as public
import tiktoken
from pyspark.sql import functions as F

from touchline.llm.byte_pieces import BytePieces, byte_characters, read_ranks, serialise, with_ids

PATH = public.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bytes_map_one_to_one():
    assert len(set(byte_characters())) == 256
    assert all(c.isprintable() and not c.isspace() for c in byte_characters())


def test_model_has_a_piece_per_rank():
    import sentencepiece

    pieces = read_ranks(PATH)
    processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(pieces))
    assert processor.get_piece_size() == len(pieces) + 1
    assert processor.get_score(1000) == -1000


def test_equals_the_rank_library(spark):
    r = random.Random(4)
    pool = [chr(c) for c in [*range(0, 300), *range(0x2000, 0x2030), 0x1F600, 0x3000, 0xFEFF, 0x660, 0x4E2D, 0x10330]]
    texts = ["".join(r.choice(pool) if r.random() < 0.3 else r.choice(" \n\tstreldm12'") for _ in range(r.randint(0, 60)))
             for _ in range(400)]
    texts += ["", None, "a" * 30_000, "<|endoftext|>", "it's we'll  x\n\n y ", "é" * 500, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("token_ids_", F.lit(1))
    coder = BytePieces(PATH, public.PATTERN)
    rows = with_ids(df, "text", coder).withColumn("raw", coder.decode(F.col("token_ids"))).collect()
    encoding = reference()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.token_ids == encoding.encode_ordinary(texts[row.doc_id] or "")
        assert bytes(row.raw).decode() == (texts[row.doc_id] or "")


def test_null_ids_and_empty_frames(spark):
    coder = BytePieces(PATH, public.PATTERN)
    rows = spark.createDataFrame([(None,), ([],), ([257, 0],)], "ids array<int>").select(coder.decode(F.col("ids")).alias("raw")).collect()
    pieces = read_ranks(PATH)
    assert [bytes(r.raw) for r in rows] == [b"", b"", pieces[257] + pieces[0]]
    assert spark.createDataFrame([], "text string").select(coder.encode(F.col("text"))).count() == 0
