"""Counter-based random draws: value of a draw depends only on (seed, row index).

A column's stream never depends on partitioning, column order or chunking: row ``i`` of the
column with sub-seed ``S`` is ``draw(S, i)``, a 32-bit unsigned integer computed by a portable
integer mixer that Spark and plain SQL engines evaluate identically:

    lo = S & 0x7fffffff,  hi = (S >> 32) & 0x7fffffff,  M = 2^32 - 1
    r(x)   = ((x xor (x >> 16)) * 73244475) & M
    mix(x) = y xor (y >> 16)  with  y = r(r(x))
    draw(i) = mix((mix((i xor lo) & M) xor hi xor (i >> 32)) & M)

All products stay below 2^63, so ANSI arithmetic never overflows.  The rounds are added as
successive projections (each round reads its input twice; nesting them in one expression would
double the expression tree per round).

Sub-seeds are derived on the driver once per column: BLAKE2b-8 over the length-prefixed decimal
root seed and labels → uint64.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

# Fixed values of the mixer.
MIX_MULT = 73244475
MASK32 = 0xFFFFFFFF
TWO32 = 1 << 32


def derive_seed(root_seed: int, *labels: str) -> int:
    """Stable uint64 sub-seed of a root seed and a path of labels."""
    h = hashlib.blake2b(digest_size=8)
    for chunk in [str(int(root_seed)).encode("utf-8")] + [lb.encode("utf-8") for lb in labels]:
        h.update(len(chunk).to_bytes(8, "big"))
        h.update(chunk)
    return int.from_bytes(h.digest(), "big")


def seed_halves(seed: int) -> tuple[int, int]:
    return seed & 0x7FFFFFFF, (seed >> 32) & 0x7FFFFFFF


def _r_sql(x: str) -> str:
    return f"((({x} ^ shiftright({x}, 16)) * {MIX_MULT}L) & {MASK32}L)"


def with_draws(df: DataFrame, index_col: str, draws: dict[str, int],
               barrier: bool = False) -> DataFrame:
    """Add one 32-bit draw column per entry of ``draws`` (name → sub-seed), indexed by
    ``index_col`` (a non-negative long row index).

    Each round is one projection; the expressions are handed over as SQL text (one call per
    round, parsed in the JVM), since building hundreds of Column objects one remote call at a
    time dominated plan construction for wide tables.

    ``barrier``: the draws will be filtered or joined on.  Catalyst pushes a filter down through
    projections by substituting each alias, which would rebuild the whole mixer as one nested
    expression whose size doubles per round; emitting the final values through a one-row
    ``inline`` (a Generate) stops the pushdown at the finished draw columns."""
    if not draws:
        return df
    keep = [f"`{c}`" for c in df.columns]
    i = f"CAST(`{index_col}` AS BIGINT)"
    t = {n: f"`__t_{n}`" for n in draws}

    def stage(exprs: dict[str, str]) -> None:
        nonlocal df
        df = df.selectExpr(*keep, *[f"{e} AS {t[n]}" for n, e in exprs.items()])

    stage({n: f"(({i} ^ {seed_halves(s)[0]}L) & {MASK32}L)" for n, s in draws.items()})
    for _ in range(2):
        stage({n: _r_sql(t[n]) for n in draws})
    stage({n: f"((({t[n]} ^ shiftright({t[n]}, 16)) ^ {seed_halves(s)[1]}L ^ shiftright({i}, 32))"
              f" & {MASK32}L)" for n, s in draws.items()})
    for _ in range(2):
        stage({n: _r_sql(t[n]) for n in draws})
    finals = [f"({t[n]} ^ shiftright({t[n]}, 16)) AS `{n}`" for n in draws]
    if barrier:
        return df.selectExpr(*keep, f"inline(array(struct({', '.join(finals)})))")
    return df.selectExpr(*keep, *finals)


def draw_py(seed: int, i: int) -> int:
    """The same draw in plain Python (tests and small driver-side checks)."""
    lo, hi = seed_halves(seed)

    def r(x: int) -> int:
        return ((x ^ (x >> 16)) * MIX_MULT) & MASK32

    def mix(x: int) -> int:
        y = r(r(x))
        return y ^ (y >> 16)

    return mix((mix((i ^ lo) & MASK32) ^ hi ^ (i >> 32)) & MASK32)


def unit_cut(rate: float) -> int:
    """A probability as an integer threshold on the 32-bit draw (``draw < cut`` ⇔ hit)."""
    return int(round(float(rate) * TWO32))
