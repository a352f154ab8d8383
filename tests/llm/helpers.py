"""Brute-force counterparts and small fixtures."""

from __future__ import annotations

from collections.abc import Iterable

WORDS = "the red fox ran over a quiet hill and saw two small boats near old stone walls while rain fell on green fields".split()


def smallest(nodes: Iterable, linked) -> dict:
    """Smallest node reachable, by plain search over all pairs."""
    nodes = sorted(set(nodes))
    low = {}
    for start in nodes:
        if start in low:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in low:
                low[x] = start
                todo += [y for y in nodes if y not in low and linked(x, y)]
    return low


def prose(r, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))
