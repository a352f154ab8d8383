"""Training-text pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Toxic documents go; lines of repeated three-line windows go; one document of every near-duplicate group stays; sources are
mixed to target weights; texts become token ids, and ids texts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import toxicity
from touchline.llm.byte_pieces import BytePieces
from touchline.llm.common import own_name, stored, table
from touchline.llm.line_windows import without_repeats
from touchline.llm.poisson_mixing import mixed
from touchline.llm.queries import TARGET_WEIGHTS, TOXIC_FROM
from touchline.llm.shingle_links import one_of_each_similar


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_FROM by models of the labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = own_name(docs, "score")
    return toxicity.with_score(docs, model, score).where(F.col(score) < TOXIC_FROM).drop(score)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of windows that occurred before; those that lose all their lines go."""
    removed = own_name(docs, "removed")
    left = without_repeats(docs, removed=removed)
    left = left.where((F.col(removed) == 0) | (F.col("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: SimHash candidates whose five-word shingles have a similarity of 0.8 or more."""
    return one_of_each_similar(docs, words=5, similar=0.8)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson numbers so that the sources have their target weights, in a hashed order."""
    return mixed(docs, TARGET_WEIGHTS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document by the 50k byte vocabulary, and whether the bytes decoded from them are the text's."""
    import public_tokenizers

    coder = BytePieces(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = docs.select("doc_id", "lang", "source", "text", coder.encode(F.col("text")).alias("token_ids"))
    same = coder.decode(F.col("token_ids")) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [("toxicity", not_toxic), ("line dedup", new_lines), ("SimHash near-dedup", one_near_duplicate),
          ("mixing to target weights", target_mix), ("byte-level BPE", token_ids)]

#: Fitted models and ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
