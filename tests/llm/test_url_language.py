"""URL rules against plain string work, and what the character models learn."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from touchline.llm.queries import URL_RULES
from touchline.llm.url_language import CELL_BITS, END, ORDER, cells, grams, judge


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len) if fits else None


def test_rules(spark):
    urls = ["http://A.Example.COM/en/1", "http://www.example.com/en/x", "https://com/", "http://com", "http://xcom/", "http://a.net/es/?q#f",
            "http://a.net/es", "http://a.net/fr/b?c", "ftp://x.net#/es/", "://q/en/", "http://example.com?x=/en/", "no scheme", "", None,
            "http://exaMple.com/EN/", "http://u@www.example.com/en/", "a://b://c.com/", "http://É.COM/é/"]
    rows = judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()
    assert len(rows) == len(urls)
    for row in rows:
        assert (row.host, row.path, row.rule) == plain(urls[row.page_id])
        assert row.verdict == URL_RULES.get(row.rule, row.verdict) and row.verdict in ("allow", "block")


def test_models_tell_languages_of_urls(spark):
    r = random.Random(6)

    def name(letters):
        return "".join(r.choice(letters) for _ in range(10))

    rows = [(i, f"http://{name('abcdef')}.good/{name('abcdef')}") for i in range(300)]
    rows += [(1000 + i, f"http://{name('uvwxyz')}.bad/{name('uvwxyz')}") for i in range(300)]
    rows += [(2000 + i, f"http://{name('abcdef')}.other/{name('abcdef')}") for i in range(50)]
    rows += [(3000 + i, f"http://{name('uvwxyz')}.other/{name('uvwxyz')}") for i in range(50)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), {"good/": "allow", "bad/": "block"}).collect()
    undecided = [(x.page_id >= 3000, x.verdict == "block") for x in got if x.rule is None]
    assert len(undecided) == 100
    assert np.mean([a == b for a, b in undecided]) > 0.97


def test_without_a_class_urls_are_allowed(spark):
    df = spark.createDataFrame([(1, "http://x.org/a"), (2, None), (3, "http://x.net/es/1"), (3, "http://x.net/es/1")], "page_id long, url string")
    got = {(x.page_id, x.verdict, x.difference) for x in judge(df, URL_RULES).collect()}
    assert got == {(1, "allow", None), (2, "allow", None), (3, "block", None)}
    assert judge(df.limit(0), URL_RULES).count() == 0


def test_grams_are_exact():
    keys, offsets = grams(pa.array(["abcdef", "", None, "é"]))
    assert offsets.tolist() == [0, 7, 8, 9, 12]
    assert keys[0][:7].tolist() == [*b"abcdef", END]
    order2 = 2 << 8 * ORDER + 8
    assert keys[2][3] == order2 | ord("b") << 16 | ord("c") << 8 | ord("d") - 0
    assert keys[2][7] == order2 | END
    assert cells(keys).max() < 1 << CELL_BITS
