"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import base64
import hashlib
import math
import subprocess
import sys
from collections import Counter

import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_native import plain_windows
from tests.llm.test_shingle_links import brute
from touchline.llm import toxicity
from touchline.llm.poisson_mixing import SEED
from touchline.llm.queries import TARGET_WEIGHTS, TOXIC_FROM

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage, by name."""
    from touchline.llm.common import stored

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF))
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_columns(stages):
    for _, _, _, before, after in stages[:-1]:
        assert before == after
    assert "doc_id" in stages[-1][4]


def test_toxicity(spark, stages):
    _, before, after, *_ = stages[0]
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scores(pa.array([x.text for x in before]))
    assert sorted(x.doc_id for x in after) == sorted(x.doc_id for x, s in zip(before, scores) if s < TOXIC_FROM)


def test_line_dedup(stages):
    _, before, after, *_ = stages[1]
    texts = dict(sorted((x.doc_id, x.text) for x in before))
    want = {i: t for i, t in plain_windows(texts.items()).items() if t or not texts[i]}
    assert {x.doc_id: x.text for x in after} == want
    assert all(x.n_chars == len(x.text) for x in after)


def test_near_duplicates(stages):
    """Five-word shingles with a similarity of 0.8 or more, by brute force over all pairs."""
    _, before, after, *_ = stages[2]
    low = brute({x.doc_id: x.text for x in before})
    assert sorted(x.doc_id for x in after) == sorted(set(low.values()))


def test_mixing(stages):
    _, before, after, *_ = stages[3]
    sizes = Counter()
    for x in before:
        sizes[x.source] += len(x.text)
    weights = {s: TARGET_WEIGHTS.get(s, 1.0) for s in sizes}
    rate = {s: weights[s] / sum(weights.values()) * sum(sizes.values()) / sizes[s] for s in sizes}

    def copies(x):
        assert rate[x.source] <= 500
        u = int(hashlib.md5(f"{SEED}|{x.doc_id}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, math.exp(-rate[x.source])
        upto = term
        while upto <= u:
            k += 1
            term *= rate[x.source] / k
            upto += term
        return k

    assert Counter(x.doc_id for x in after) == Counter({x.doc_id: copies(x) for x in before if copies(x)})


def test_ids(stages):
    _, before, after, *_ = stages[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {x.doc_id: encoding.encode_ordinary(x.text) for x in before}
    assert Counter(x.doc_id for x in after) == Counter(x.doc_id for x in before)
    assert all(x.token_ids == ids[x.doc_id] and x.n_tokens == len(x.token_ids) and x.round_trip for x in after)


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (7001, None, None, None, None), (7002, "", "", "", 0),
                                 (7003, "w " * 50_000, "en", "src0", 1), (None, "a b c", "en", None, 5)], docs.schema)
    docs.union(docs.limit(5)).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("round_trip").count() > 10


def test_entry_without_this_package(tmp_path):
    """The registry still imports where the package and the pipeline are gone."""
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for name in ("__spark_entry__.py", "touchline"):
        (tmp_path / name).symlink_to(root / name) if name.endswith("py") else None
    (tmp_path / "touchline").mkdir()
    for p in (root / "touchline").iterdir():
        if p.name != "llm":
            (tmp_path / "touchline" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), "
                           "'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[1:] == ["False", "False", "True"], said.stderr
