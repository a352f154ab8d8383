"""Registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import new_folder, table, text_of

TOXIC_FROM = 0.3  # score from which a document is predicted to be toxic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the 50k byte vocabulary, and the bytes decoded from them, as digests."""
    import public_tokenizers

    from touchline.llm.byte_pieces import BytePieces

    coder = BytePieces(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = table(spark, sf_dir, "documents").select("doc_id", coder.encode(F.col("text")).alias("token_ids"))
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(coder.decode(F.col("token_ids")), 256).alias("decoded_sha256"),
    )


@query
def op9_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles of every document, and its component by links at 4 or fewer differing bits."""
    from touchline.llm.simhash_links import as_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document, compared with those of an edited text and of the next document."""
    from touchline.llm.winnowing import compared_with_next

    return compared_with_next(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by class models of the labelled documents that are not held out."""
    from touchline.llm import toxicity

    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(documents.select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("held_out")), model, "score")
    return scored.drop("text").withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


#: Relative target weights of sources; one that isn't named has weight 1.
TARGET_WEIGHTS = {"src0": 6.0}


@query
def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated by Poisson numbers so that the sources have their target weights, in a hashed order."""
    from touchline.llm.poisson_mixing import mixed

    return mixed(table(spark, sf_dir, "documents"), TARGET_WEIGHTS, copy="copy")


@query
def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of three-line windows that occurred before."""
    from touchline.llm.line_windows import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), removed="lines_removed")


@query
def op8_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: spans of the patterns and those that the character model adds."""
    from touchline.llm.secret_markov import as_text, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
                        as_text(F.col("spans")).alias("spans"))


#: The rules of the URL query.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


@query
def op1_url_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, or by models of the characters of the urls that rules accept and reject."""
    from touchline.llm.url_language import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op5_quantised_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors of a label with a cosine of 0.98 or more."""
    from touchline.llm.quantised_links import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.98).withColumnRenamed("component", "component_id")


@query
def op4_dom_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the model of its DOM."""
    from touchline.llm.dom_field import fitted, main_text

    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", main_text(F.col("html"), fitted(pages)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, one in ten with a planted period, and the texts without the repeats."""
    from touchline.llm.periodic_runs import periodic_runs, with_planted_period

    found = table(spark, sf_dir, "documents").select(
        "doc_id", periodic_runs(with_planted_period(F.col("text"), F.col("doc_id"))).alias("f"))
    best = F.get("f.runs", F.col("f.best"))
    lines = F.transform("f.runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    return found.select(
        "doc_id",
        F.size("f.runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.concat(lines, F.array(F.lit(""))), "\n"), 256).alias("runs_sha256"),
        F.sha2("f.collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_anchor_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh vector has the next label."""
    from touchline.llm.anchor_trees import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives of one gzip stream each, normalised to a member per record, and read back."""
    from touchline.llm import warc

    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.as_records(pages, "page_id", "url", "html"), f"{folder}/streams")
    warc.normalise(spark, f"{folder}/streams", f"{folder}/normalised")
    found = warc.payloads_of(warc.read_archives(spark, f"{folder}/normalised"))
    kind = dict(pages.dtypes)["page_id"]
    return found.select(
        warc.key_of(F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.key_of(F.col("refers_to")).cast(kind).alias("refers_to"))
