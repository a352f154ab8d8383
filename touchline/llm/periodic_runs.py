"""Runs of words that repeat with a period, by the dictionary of basic factors.

Level k names every stretch of L = 2^k words, so that equal stretches have equal names: level 0 names words, and a name of
level k + 1 stands for a pair of names of level k. Occurrences of one stretch inside 2L words form an arithmetic
progression, whose step is the stretch's period. So wherever the next occurrence (the successor) of the stretch at i comes g
<= L words later, g is proposed as a period at i. A stretch that starts one word later and has the same successor distance
carries the repetition on by a word; proposals are extended by joining such neighbours. If starts a to b all have the
distance g and their neighbours don't, words a to b + L + g - 1 have the period g, no smaller one, and no neighbouring word
keeps it: a smaller period, or a longer repetition, would show as another distance at a, a - 1 or b + 1.

A run of period q shows at every level with q <= L and q + L words in the run. With at least three periods in the run the
smallest level of L >= q is one of them (L < 2q), so each level keeps the distances above L / 2 only, and what levels near 1 share is
deduplicated. A text of n words costs O(n log n) per level, log2(n) levels at most, and levels end as soon as no stretch
occurs twice. Memory is one level's names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.llm.common import slices_by_size

SCHEMA = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, best: int, collapsed: string>"


def word_names(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of every key, starts that have a successor, distance to it)."""
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    names = np.empty(len(keys), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~again)])
    starts = order[:-1][again]
    gaps = order[1:][again] - starts
    by_place = np.argsort(starts, kind="stable")
    return names, starts[by_place], gaps[by_place]


def runs_of(names: np.ndarray, times: int = 4, least: int = 6) -> np.ndarray:
    """(start, length, period) of all maximal runs with a length of at least max(least, times * period), by start, then period.

    `times` is 3 or more: runs of fewer periods need not hold a stretch of the dictionary and its successor. Several runs may
    overlap or start at one word.
    """
    if times < 3:
        raise ValueError("a run has at least three periods")
    found, n, size = [], len(names), 1
    while n >= max(least, times * (size // 2 + 1)):
        names, starts, gaps = _named(names)
        if not len(starts):
            break  # all stretches differ, and so do longer ones
        near = gaps <= size
        starts, gaps = starts[near], gaps[near]
        if len(starts):
            edge = np.flatnonzero((starts[1:] != starts[:-1] + 1) | (gaps[1:] != gaps[:-1]))
            first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(starts) - 1]])
            period = gaps[first]
            length = starts[last] + size + period - starts[first]
            kept = (length >= np.maximum(least, times * period)) & (2 * period > size)
            found.append(np.stack([starts[first], length, period], axis=1)[kept])
        if len(names) <= size:
            break
        names = names[:-size] * (len(names) + 1) + names[size:]
        size *= 2
    rows = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def greatest(rows: np.ndarray) -> int | None:
    """Place of the run with the greatest exact length / period; the first of equal ones. None if there is none."""
    best = None
    for i, (_, length, period) in enumerate(rows.tolist()):
        if best is None or length * best[2] > best[1] * period:
            best = (i, length, period)
    return None if best is None else best[0]


def kept_words(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def periodic_runs(text: Column, times: int = 4, least: int = 6) -> Column:
    """struct<n_words, runs: array<struct<start, length, period>>, best, collapsed> of a text column.

    Words are what stands between spaces and the controls 0x09 to 0x0D. `runs` are ordered by start, then period; `best` is
    the place (from 0) of the run with the greatest length / period, null without a run; `collapsed` are the kept words,
    joined by one space. Null and empty texts, and texts of white space, have no words, no runs and an empty `collapsed`.
    Long texts are read whole, by one task each. No other column is looked at, repeated rows get equal results, an empty
    table gives an empty one.
    """

    @arrow_udf(SCHEMA)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices_by_size(batches):
            out = []
            for value in texts:
                words = (value.as_py() or b"").split()
                rows = runs_of(word_names(words), times, least)
                kept = words
                if len(rows):
                    kept = [words[i] for i in np.flatnonzero(kept_words(len(words), rows))]
                runs = [dict(zip(("start", "length", "period"), row)) for row in rows.tolist()]
                out.append({"n_words": len(words), "runs": runs, "best": greatest(rows), "collapsed": b" ".join(kept).decode("utf-8", "replace")})
            yield pa.array(out, _TYPE)

    return found(text.cast("binary"))


_TYPE = pa.struct([
    ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("best", pa.int32()), ("collapsed", pa.string())])


def with_planted_period(text: Column, key: Column) -> Column:
    """The text in which, for one key in ten, the words from a place on repeat the p words there.

    With h = crc32 of the key's decimal text and g = h div 10, texts of h mod 10 = 0 with n > 0 words have word i >= a replaced by
    word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8), words joined by one space. Other texts, and
    those of a null key, stay as they are.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^ \x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0),
                  F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " ")).otherwise(text)
