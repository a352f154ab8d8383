"""Text of the seeded draws for the checking SQL (same integer steps as functions.probability)."""

from touchline.functions.probability import PRIME, UPPER

_M = str(PRIME)


def uniform_from(source: str, out: str, seed: int, *parts: str) -> str:
    """`source` with a seeded uniform column `out`, step by step as nested selects."""
    sql = f"(SELECT *, cast({seed} as bigint) AS _x FROM {source})"
    for p in parts:
        rest = f"(cast({p} as bigint) % {_M})"
        times = f"((cast({p} as bigint) - {rest}) // {_M} - case when {rest} < 0 then 1 else 0 end)"
        low, upper = f"(({rest} + {_M}) % {_M})", f"((({times} % {_M} + {_M}) % {_M} * {UPPER}) % {_M})"
        sql = f"(SELECT * REPLACE ((((_x * 31 + {low} + {upper}) % {_M}) * 1597334677) % {_M} AS _x) FROM {sql})"
        sql = f"(SELECT * REPLACE ((xor(_x, _x >> 15) * 747796405) % {_M} AS _x) FROM {sql})"
        sql = f"(SELECT * REPLACE ((xor(_x, _x >> 13) * 1274126177) % {_M} AS _x) FROM {sql})"
    return f"(SELECT * EXCLUDE (_x), _x / {_M}.0 AS {out} FROM {sql})"
