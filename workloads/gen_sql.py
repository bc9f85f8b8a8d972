"""DuckDB SQL text for the oracle side of generation workloads.

Mirrors, in SQL, the counter-based draw and the Column builders of ``ferrule.functions``: the
oracle regenerates the same values independently of Spark.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from ferrule.functions import corpus as C
from ferrule.functions.draw import MASK32, MIX_MULT, derive_seed, seed_halves, unit_cut
from ferrule.functions.generators import (_date_days, _decimal_units, _ts_span, _as_date,
                                          _as_datetime, categorical_cuts)

from .common import q


def _r(x: str) -> str:
    return f"((xor({x}, {x} >> 16) * {MIX_MULT}) & {MASK32})"


def draws_sql(base: str, index: str, draws: dict[str, int]) -> str:
    """``base`` (a subquery) plus one draw column per (name → seed), indexed by ``index``."""
    if not draws:
        return base
    cur = base
    tn = {n: f"__t_{n}" for n in draws}
    cols = ", ".join(f"(xor(CAST({index} AS BIGINT), {seed_halves(s)[0]}) & {MASK32}) AS {tn[n]}"
                     for n, s in draws.items())
    cur = f"SELECT *, {cols} FROM ({cur})"
    def rep(exprs: dict[str, str]) -> None:
        nonlocal cur
        cur = f"SELECT * REPLACE ({', '.join(f'{e} AS {tn[n]}' for n, e in exprs.items())}) FROM ({cur})"
    for _ in range(2):
        rep({n: _r(tn[n]) for n in draws})
    rep({n: f"(xor(xor(xor({tn[n]}, {tn[n]} >> 16), {seed_halves(s)[1]}), "
            f"CAST({index} AS BIGINT) >> 32) & {MASK32})" for n, s in draws.items()})
    for _ in range(2):
        rep({n: _r(tn[n]) for n in draws})
    fin = ", ".join(f"xor({tn[n]}, {tn[n]} >> 16) AS {n}" for n in draws)
    excl = ", ".join(tn.values())
    return f"SELECT * EXCLUDE ({excl}), {fin} FROM ({cur})"


def draw_seeds(seed: int, table: str, column: str, n: int) -> list[int]:
    return [derive_seed(seed, table, column) if k == 0 else
            derive_seed(seed, table, column, f"__draw{k}__") for k in range(n)]


def _lit(v: Any) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return q(str(v))


def _list(values: list[Any]) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def pick(values: list[Any], idx: str) -> str:
    return f"({_list(values)})[CAST({idx} AS BIGINT) + 1]"


def draw63(d: list[str]) -> str:
    return f"(({d[0]} << 31) | ({d[1]} >> 1))"


def uniform_below(d: list[str], span: int) -> str:
    """Draws by the width of the span (limits stated here on their own: 2^20 and 2^42)."""
    if span <= 1 << 20:
        return f"({d[0]} % {span})"
    if span <= 1 << 42:
        return f"({draw63(d)} % {span})"
    return (f"((CAST({draw63(d)} AS HUGEINT) * CAST('9223372036854775808' AS HUGEINT) + "
            f"CAST({draw63(d[2:])} AS HUGEINT)) % CAST('{span}' AS HUGEINT))")


def _idx(d: str, n: int, shift: int = 0) -> str:
    src = f"({d} >> {shift})" if shift else d
    return f"({src} % {n})"


def _hex8(d: str) -> str:
    return f"lpad(lower(hex({d})), 8, '0')"


def _sentence(d: list[str]) -> str:
    n = f"({_idx(d[0], 7)} + 4)"
    words = [pick(C.WORDS, f"(({d[1 + j // 5]} >> {6 * (j % 5)}) & 63)") for j in range(10)]
    s = f"array_to_string(list_slice([{', '.join(words)}], 1, {n}), ' ')"
    return f"(upper(substring({s}, 1, 1)) || substring({s}, 2) || '.')"


def _uuid4(d: list[str]) -> str:
    h = [_hex8(x) for x in d]
    variant = pick(["8", "9", "a", "b"], _idx(d[2], 4))
    return (f"({h[0]} || '-' || substring({h[1]}, 1, 4) || '-4' || substring({h[1]}, 6, 3) || '-' || "
            f"{variant} || substring({h[2]}, 2, 3) || '-' || substring({h[2]}, 5, 4) || {h[3]})")


FAKER_SQL = {
    "word": lambda d: pick(C.WORDS, _idx(d[0], len(C.WORDS))),
    "first_name": lambda d: pick(C.FIRST_NAMES, _idx(d[0], len(C.FIRST_NAMES))),
    "last_name": lambda d: pick(C.LAST_NAMES, _idx(d[0], len(C.LAST_NAMES))),
    "name": lambda d: (f"({pick(C.FIRST_NAMES, _idx(d[0], len(C.FIRST_NAMES)))} || ' ' || "
                       f"{pick(C.LAST_NAMES, _idx(d[1], len(C.LAST_NAMES)))})"),
    "email": lambda d: (f"(lower({pick(C.FIRST_NAMES, _idx(d[0], len(C.FIRST_NAMES)))}) || '.' || "
                        f"lower({pick(C.LAST_NAMES, _idx(d[1], len(C.LAST_NAMES)))}) || "
                        f"CAST({_idx(d[2], 10000)} AS VARCHAR) || '@' || "
                        f"{pick(C.EMAIL_DOMAINS, _idx(d[2], len(C.EMAIL_DOMAINS), 16))})"),
    "user_name": lambda d: (f"(lower({pick(C.FIRST_NAMES, _idx(d[0], len(C.FIRST_NAMES)))}) || '_' || "
                            f"CAST({_idx(d[1], 10000)} AS VARCHAR))"),
    "phone_number": lambda d: (f"('+1-' || CAST({_idx(d[0], 800)} + 200 AS VARCHAR) || '-555-' || "
                               f"lpad(CAST({_idx(d[1], 10000)} AS VARCHAR), 4, '0'))"),
    "address": lambda d: (f"(CAST({_idx(d[0], 9999)} + 1 AS VARCHAR) || ' ' || "
                          f"{pick(C.STREETS, _idx(d[1], len(C.STREETS)))} || ' ' || "
                          f"{pick(C.STREET_SUFFIXES, _idx(d[1], len(C.STREET_SUFFIXES), 16))})"),
    "city": lambda d: pick(C.CITIES, _idx(d[0], len(C.CITIES))),
    "country": lambda d: pick(C.COUNTRIES, _idx(d[0], len(C.COUNTRIES))),
    "company": lambda d: (f"({pick(C.LAST_NAMES, _idx(d[0], len(C.LAST_NAMES)))} || ' ' || "
                          f"{pick(C.COMPANY_SUFFIXES, _idx(d[1], len(C.COMPANY_SUFFIXES)))})"),
    "url": lambda d: (f"('https://www.' || {pick(C.WORDS, _idx(d[0], 64))} || "
                      f"{pick(C.WORDS, _idx(d[1], 64))} || '.' || "
                      f"{pick(C.TLDS, _idx(d[1], len(C.TLDS), 16))} || '/')"),
    "sentence": _sentence,
    "uuid4": _uuid4,
    "json": lambda d: (f"('{{\"id\":' || CAST({_idx(d[0], 100000)} AS VARCHAR) || ',\"tag\":\"' || "
                       f"{pick(C.WORDS, _idx(d[1], 64))} || '\"}}')"),
}


def gen_expr(kind: str, p: dict[str, Any], d: list[str], row: str, sql_type: str,
             precision: int | None = None, tz: bool = False) -> str:
    """SQL expression of one generated column (before null injection)."""
    if kind == "serial":
        e = f"({int(p.get('start', 1))} + {row})"
    elif kind == "int_range":
        e = f"(CAST('{int(p['low'])}' AS HUGEINT) + {uniform_below(d, int(p['high']) - int(p['low']) + 1)})"
    elif kind == "categorical":
        vals = list(p["values"])
        if p.get("weights") is None:
            e = pick(vals, f"({d[0]} % {len(vals)})")
        else:
            cuts = categorical_cuts(list(p["weights"]))
            arms = " ".join(f"WHEN {d[0]} < {c} THEN {_lit(v)}"
                            for v, c in zip(vals[:-1], cuts[:-1], strict=True))
            e = f"(CASE {arms} ELSE {_lit(vals[-1])} END)"
    elif kind == "decimal_range":
        s = int(p.get("scale", 2))
        lo_u, hi_u = _decimal_units(p, s)
        digits = max(len(str(abs(lo_u))), len(str(abs(hi_u))), 1)
        units = f"({lo_u} + {uniform_below(d, hi_u - lo_u + 1)})"
        e = f"(CAST({units} AS DECIMAL({min(38, digits)},0)) * {Decimal(1).scaleb(-s)})"
    elif kind == "date_range":
        e = f"(DATE '{_as_date(p['low']).isoformat()}' + CAST({uniform_below(d, _date_days(p))} AS INTEGER))"
    elif kind == "timestamp_range":
        low = _as_datetime(p["low"]).isoformat(sep=" ")
        e = f"(TIMESTAMP '{low}' + to_seconds({uniform_below(d, _ts_span(p))}))"
        if tz:
            e = f"CAST({e} AS TIMESTAMPTZ)"
    elif kind == "faker":
        e = FAKER_SQL[p["method"]](d)
    else:
        raise ValueError(kind)
    return f"CAST({e} AS {sql_type})"


def null_wrap(expr: str, null_draw: str, rate: float) -> str:
    return f"(CASE WHEN {null_draw} < {unit_cut(rate)} THEN NULL ELSE {expr} END)"
