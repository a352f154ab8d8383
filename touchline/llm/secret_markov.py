"""Secrets in texts: patterns, and a character Markov model that adds what patterns miss.

Candidates are long runs of characters that keys are written in. Those that touch a pattern's span are labelled random
strings, the others ordinary identifiers; both give counts of neighbouring characters over all texts, which back off to those
of single characters by the number of different followers (Witten and Bell). A candidate outside
the patterns' spans is added if its log-likelihood ratio (without one count of each of its own pairs) and the prior odds of the labels favour the random strings.

Everything is DataFrame expressions. The model is one array of 128 x 128 ratios of ASCII characters, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored, text_of


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the three kinds, the least length of group `GROUP` and the order of the kinds.
WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = f"({'|'.join(either_case(w) for w in WORDS)})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
PATTERNS = ((ASSIGN, 2, 6, f"({'|'.join(either_case(w) for w in WORDS)})[\"']?\\x20*[:=]"), (ACCESS, 0, 20, "AKIA"),
            (HEX, 0, 24, "[0-9a-f]{24}"))

CANDIDATE_LENGTH = 16
CANDIDATE = f"[A-Za-z0-9+/_-]{{{CANDIDATE_LENGTH},}}={{0,2}}"
ALPHABET = 65  # characters a candidate can hold
PSEUDO = 1.0  # count given to every character beforehand, so that a model without samples is uniform

_SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


def _matches(text: Column, pattern: str, kind: int, group: int, least: int, where: str | None, value: bool) -> Column:
    """Spans (start, kind, end, value) of a pattern's matches whose group is long enough, in code points.

    A text is the pieces between matches and the matches in turn, so lengths add up to places.
    """
    empty = F.array().cast(_SPANS)
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    if where:
        pieces = F.when(text.rlike(where), pieces)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["all"]), F.lit(0))
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"),
                        (x["part"] if value else F.lit(None).cast("string")).alias("v"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(done["spans"], F.array(span)))
                        .otherwise(done["spans"]).alias("spans"))

    return F.coalesce(F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda d: d["spans"]), empty)


def _touches(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def _pairs(value: Column) -> Column:
    return F.sequence(F.lit(1), F.length(value) - 1)


def _code(value: Column, i: Column) -> Column:
    return F.ascii(F.substring(value, i, F.lit(1))) * 128 + F.ascii(F.substring(value, i + 1, F.lit(1)))


def located(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, base, candidates): the patterns' spans, by start and then kind, and all candidates' spans with their characters."""
    t = F.col("_t")
    rows = df.select(F.col(key), text_of(text).alias("_t"))
    found = [_matches(t, pattern, kind, group, least, where, False) for kind, (pattern, group, least, where) in enumerate(PATTERNS)]
    return rows.select(F.col(key), F.array_sort(F.concat(*found)).alias("base"),
                       _matches(t, CANDIDATE, 3, 0, 1, None, True).alias("candidates"))


def trained(found: DataFrame) -> DataFrame:
    """One row: `ratio`, the log-likelihood ratio random : ordinary of every pair of ASCII characters, and `prior`, the log odds."""
    each = found.select("base", F.explode("candidates").alias("x")).select(
        _touches(F.col("base"), F.col("x")).alias("random"), F.col("x.v").alias("v"))
    codes = each.select("random", F.posexplode(F.transform(_pairs(F.col("v")), lambda i: _code(F.col("v"), i))).alias("n", "code"))
    first = F.col("n") == 0
    counts = codes.groupBy("code").agg(
        F.count_if("random").alias("random"), F.count_if(~F.col("random")).alias("ordinary"),
        F.count_if(F.col("random") & first).alias("randoms"), F.count_if(~F.col("random") & first).alias("ordinaries"))
    grid = found.sparkSession.range(128 * 128).select(F.col("id").cast("int").alias("code")).join(stored(counts), "code", "left")
    grid = stored(grid.fillna(0).select("*", F.floor(F.col("code") / 128).alias("before"), (F.col("code") % 128).alias("after")))
    classes = ("random", "ordinary")
    firsts = grid.groupBy("before").agg(*[F.sum(c).alias(f"{c}_n") for c in classes],
                                        *[F.greatest(F.count_if(F.col(c) > 0), F.lit(1)).alias(f"{c}_kinds") for c in classes])
    seconds = grid.groupBy("after").agg(*[F.sum(c).alias(f"{c}_after") for c in classes])
    total = grid.agg(*[F.sum(c).alias(c) for c in classes])

    def share(c: str) -> Column:
        alone = (F.col(f"{c}_after") + PSEUDO) / (total.select(c).scalar() + PSEUDO * ALPHABET)
        own = F.lit(1 if c == "ordinary" else 0)  # what is scored was counted as ordinary, and is left out again
        count, before = F.greatest(F.col(c) - own, F.lit(0)), F.greatest(F.col(f"{c}_n") - own, F.lit(0))
        return (count + F.col(f"{c}_kinds") * alone) / (before + F.col(f"{c}_kinds"))

    ratio = F.log(share("random") / share("ordinary"))
    table = stored(grid.join(firsts, "before").join(seconds, "after").select("code", ratio.alias("x"), "randoms", "ordinaries"))
    return table.agg(
        F.array_sort(F.collect_list(F.struct("code", "x"))).getField("x").alias("ratio"),
        F.log((F.sum("randoms") + 1) / (F.sum("ordinaries") + 1)).alias("prior"))


def find_secrets(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, base, spans): the patterns' spans, and these with the model's, each by start and then kind.

    Spans are structs s, k, e: first code point, kind (place in KINDS) and end, exclusive. A null text has none. Repeated
    rows come out as often as they went in; without any random string the random model is uniform.
    """
    found = stored(located(df, text, key))
    model = stored(trained(found))
    ratio, prior = model.select("ratio").scalar(), model.select("prior").scalar()
    rows = found.select("*", ratio.alias("_ratio"), prior.alias("_prior"))

    def evidence(x: Column) -> Column:
        return F.aggregate(_pairs(x["v"]), F.col("_prior"), lambda s, i: s + F.col("_ratio")[_code(x["v"], i)])

    added = F.filter("candidates", lambda x: ~_touches(F.col("base"), x) & (evidence(x) > 0))
    bare = "array<struct<s:int,k:int,e:int>>"

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).cast(bare)

    return rows.select(F.col(key), plain(F.col("base")).alias("base"),
                       F.array_sort(plain(F.concat("base", added))).alias("spans"))


def as_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")
