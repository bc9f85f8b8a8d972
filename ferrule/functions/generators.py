"""Generator registry: generator kind → number of draws + a Column builder.

Every builder receives the column's draw Columns (unsigned 32-bit values as longs, one per
label) and the global row index, and returns a Column of the column's canonical type.  All of
them are plain Catalyst expressions, so generation stays inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.types import CanonicalType
from . import corpus as C
from .draw import TWO32, unit_cut


@dataclass(frozen=True)
class GenContext:
    draws: list[Column]
    row: Column
    ctype: CanonicalType


@dataclass(frozen=True)
class Generator:
    kind: str
    n_draws: Callable[[dict[str, Any]], int]
    build: Callable[[dict[str, Any], GenContext], Column]


# A 32-bit draw serves spans up to 2^20 (no value is more than 1/4096 likelier than
# another), two draws (63 bits) spans up to 2^42, four draws (126 bits, decimal arithmetic) the rest.
NARROW_SPAN = 1 << 20
WIDE_SPAN = 1 << 42


def _span_draws(span: int) -> int:
    return 1 if span <= NARROW_SPAN else 2 if span <= WIDE_SPAN else 4


def _draw63(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 31).bitwiseOR(F.shiftright(low, 1))


def uniform_below(draws: list[Column], span: int) -> Column:
    """An integer in [0, span): a long, or decimal(38,0) for spans over ``WIDE_SPAN``."""
    n = _span_draws(span)
    if n == 1:
        return draws[0] % F.lit(span).cast("long")
    if n == 2:
        return _draw63(*draws[:2]) % F.lit(span).cast("long")
    whole = T.DecimalType(38, 0)
    high, low = _draw63(*draws[:2]).cast(T.DecimalType(19, 0)), _draw63(*draws[2:4]).cast(whole)
    return ((high * F.lit(Decimal(1 << 63)).cast(T.DecimalType(19, 0))).cast(whole) + low).cast(whole) % F.lit(Decimal(span)).cast(whole)


_SEP = "\x1f"


def pick(values: list[Any], index: Column) -> Column:
    """``values[index]`` from a literal list (index in [0, len)).

    String lists become ``split(<one literal>, <separator>)`` — a single foldable node that
    Catalyst turns into a constant array, instead of one literal node per value (large corpora
    repeated across columns would otherwise make plan analysis slow)."""
    if all(isinstance(v, str) and _SEP not in v for v in values):
        arr = F.split(F.lit(_SEP.join(values)), _SEP)
    else:
        arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (index + 1).cast("int"))


# --- numeric and temporal -------------------------------------------------------------------

def _int_span(p: dict[str, Any]) -> int:
    return int(p["high"]) - int(p["low"]) + 1


def _int_range(p: dict[str, Any], ctx: GenContext) -> Column:
    span = _int_span(p)
    low = F.lit(Decimal(int(p["low"]))).cast("decimal(38,0)") if span > WIDE_SPAN else F.lit(int(p["low"])).cast("long")
    return (low + uniform_below(ctx.draws, span)).cast("long")


def _serial(p: dict[str, Any], ctx: GenContext) -> Column:
    return F.lit(int(p.get("start", 1))).cast("long") + ctx.row


def _decimal_units(p: dict[str, Any], scale: int) -> tuple[int, int]:
    q = Decimal(1).scaleb(-scale)
    lo = Decimal(str(p["low"]))
    hi = Decimal(str(p["high"]))
    # bounds finer than the scale are moved inward so every value stays inside [low, high]
    lo_u = int((lo / q).to_integral_value(rounding="ROUND_CEILING"))
    hi_u = int((hi / q).to_integral_value(rounding="ROUND_FLOOR"))
    if hi_u < lo_u:
        raise ValueError(f"decimal_range [{lo}, {hi}] holds no value at scale {scale}")
    return lo_u, hi_u


def _decimal_scale(p: dict[str, Any], ctx: GenContext) -> int:
    return int(p.get("scale", ctx.ctype.scale if ctx.ctype.scale is not None else 2))


def _decimal_draws(p: dict[str, Any]) -> int:
    lo_u, hi_u = _decimal_units(p, int(p.get("scale", 2)))
    return _span_draws(hi_u - lo_u + 1)


def _decimal_range(p: dict[str, Any], ctx: GenContext) -> Column:
    s = _decimal_scale(p, ctx)
    lo_u, hi_u = _decimal_units(p, s)
    span = hi_u - lo_u + 1
    low = F.lit(Decimal(lo_u)).cast("decimal(38,0)") if span > WIDE_SPAN else F.lit(lo_u).cast("long")
    units = low + uniform_below(ctx.draws, span)
    digits = max(len(str(abs(lo_u))), len(str(abs(hi_u))), 1)
    exact = units.cast(T.DecimalType(min(38, digits), 0)) * F.lit(Decimal(1).scaleb(-s))
    p_out = ctx.ctype.precision or min(38, digits + 1)
    return exact.cast(T.DecimalType(p_out, s))


def _as_date(v: Any) -> date:
    return v if isinstance(v, date) and not isinstance(v, datetime) else date.fromisoformat(str(v))


def _as_datetime(v: Any) -> datetime:
    d = v if isinstance(v, datetime) else datetime.fromisoformat(str(v))
    if d.tzinfo is not None:
        raise ValueError("give timestamp_range bounds as naive datetimes")
    return d


def _date_days(p: dict[str, Any]) -> int:
    return (_as_date(p["high"]) - _as_date(p["low"])).days + 1


def _date_range(p: dict[str, Any], ctx: GenContext) -> Column:
    off = uniform_below(ctx.draws, _date_days(p))
    return F.date_add(F.lit(_as_date(p["low"])), off.cast("int"))


def _ts_span(p: dict[str, Any]) -> int:
    return int((_as_datetime(p["high"]) - _as_datetime(p["low"])).total_seconds()) + 1


def _timestamp_range(p: dict[str, Any], ctx: GenContext) -> Column:
    secs = uniform_below(ctx.draws, _ts_span(p))
    low = F.lit(_as_datetime(p["low"]).isoformat(sep=" ")).cast("timestamp_ntz")
    ts = F.timestamp_add("SECOND", secs, low)
    return ts.cast("timestamp") if ctx.ctype.tz else ts


# --- categorical ----------------------------------------------------------------------------

def categorical_cuts(weights: list[float]) -> list[int]:
    """Cumulative weights as integer thresholds on the 32-bit draw (last one = 2^32)."""
    total = float(sum(weights))
    acc, cuts = 0.0, []
    for w in weights[:-1]:
        acc += float(w)
        cuts.append(unit_cut(acc / total))
    return cuts + [TWO32]


def _categorical(p: dict[str, Any], ctx: GenContext) -> Column:
    values = list(p["values"])
    weights = p.get("weights")
    if weights is None:
        return pick(values, ctx.draws[0] % F.lit(len(values)).cast("long"))
    cuts = categorical_cuts(list(weights))
    out = F.lit(values[-1])
    for v, cut in reversed(list(zip(values[:-1], cuts[:-1], strict=True))):
        out = F.when(ctx.draws[0] < F.lit(cut).cast("long"), F.lit(v)).otherwise(out)
    return out


# --- text corpus ("faker" methods re-expressed as corpus lookups) ---------------------------

def _idx(d: Column, n: int, shift: int = 0) -> Column:
    src = F.shiftright(d, shift) if shift else d
    return src % F.lit(n).cast("long")


def _hex8(d: Column) -> Column:
    return F.lpad(F.lower(F.hex(d)), 8, "0")


def _sentence(d: list[Column]) -> Column:
    n = _idx(d[0], 7) + 4
    words = [pick(C.WORDS, F.shiftright(d[1 + j // 5], 6 * (j % 5)).bitwiseAND(F.lit(63).cast("long")))
             for j in range(10)]
    s = F.array_join(F.slice(F.array(*words), F.lit(1), n.cast("int")), " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20), F.lit("."))


def _uuid4(d: list[Column]) -> Column:
    h = [_hex8(x) for x in d]
    variant = pick(["8", "9", "a", "b"], _idx(d[2], 4))
    return F.concat(h[0], F.lit("-"), F.substring(h[1], 1, 4), F.lit("-4"), F.substring(h[1], 6, 3),
                    F.lit("-"), variant, F.substring(h[2], 2, 3), F.lit("-"), F.substring(h[2], 5, 4),
                    h[3])


FAKER_METHODS: dict[str, tuple[int, Callable[[list[Column]], Column]]] = {
    "word": (1, lambda d: pick(C.WORDS, _idx(d[0], len(C.WORDS)))),
    "first_name": (1, lambda d: pick(C.FIRST_NAMES, _idx(d[0], len(C.FIRST_NAMES)))),
    "last_name": (1, lambda d: pick(C.LAST_NAMES, _idx(d[0], len(C.LAST_NAMES)))),
    "name": (2, lambda d: F.concat(pick(C.FIRST_NAMES, _idx(d[0], len(C.FIRST_NAMES))), F.lit(" "),
                                   pick(C.LAST_NAMES, _idx(d[1], len(C.LAST_NAMES))))),
    "email": (3, lambda d: F.concat(
        F.lower(pick(C.FIRST_NAMES, _idx(d[0], len(C.FIRST_NAMES)))), F.lit("."),
        F.lower(pick(C.LAST_NAMES, _idx(d[1], len(C.LAST_NAMES)))),
        _idx(d[2], 10000).cast("string"), F.lit("@"),
        pick(C.EMAIL_DOMAINS, _idx(d[2], len(C.EMAIL_DOMAINS), 16)))),
    "user_name": (2, lambda d: F.concat(
        F.lower(pick(C.FIRST_NAMES, _idx(d[0], len(C.FIRST_NAMES)))), F.lit("_"),
        _idx(d[1], 10000).cast("string"))),
    "phone_number": (2, lambda d: F.concat(
        F.lit("+1-"), (_idx(d[0], 800) + 200).cast("string"), F.lit("-555-"),
        F.lpad(_idx(d[1], 10000).cast("string"), 4, "0"))),
    "address": (2, lambda d: F.concat(
        (_idx(d[0], 9999) + 1).cast("string"), F.lit(" "),
        pick(C.STREETS, _idx(d[1], len(C.STREETS))), F.lit(" "),
        pick(C.STREET_SUFFIXES, _idx(d[1], len(C.STREET_SUFFIXES), 16)))),
    "city": (1, lambda d: pick(C.CITIES, _idx(d[0], len(C.CITIES)))),
    "country": (1, lambda d: pick(C.COUNTRIES, _idx(d[0], len(C.COUNTRIES)))),
    "company": (2, lambda d: F.concat(
        pick(C.LAST_NAMES, _idx(d[0], len(C.LAST_NAMES))), F.lit(" "),
        pick(C.COMPANY_SUFFIXES, _idx(d[1], len(C.COMPANY_SUFFIXES))))),
    "url": (2, lambda d: F.concat(
        F.lit("https://www."), pick(C.WORDS, _idx(d[0], 64)), pick(C.WORDS, _idx(d[1], 64)),
        F.lit("."), pick(C.TLDS, _idx(d[1], len(C.TLDS), 16)), F.lit("/"))),
    "sentence": (3, _sentence),
    "uuid4": (4, _uuid4),
    "json": (2, lambda d: F.concat(
        F.lit('{"id":'), _idx(d[0], 100000).cast("string"), F.lit(',"tag":"'),
        pick(C.WORDS, _idx(d[1], 64)), F.lit('"}'))),
}


def _faker_draws(p: dict[str, Any]) -> int:
    return FAKER_METHODS[_method(p)][0]


def _method(p: dict[str, Any]) -> str:
    m = p["method"]
    if m not in FAKER_METHODS:
        raise ValueError(f"unknown text method {m!r}; known: {sorted(FAKER_METHODS)}")
    return m


def _faker(p: dict[str, Any], ctx: GenContext) -> Column:
    return FAKER_METHODS[_method(p)][1](ctx.draws)


def _normal(p: dict[str, Any], ctx: GenContext) -> Column:
    """Box-Muller on two draws: sqrt(-2 ln u) cos(2 pi v), u in (0, 1), rounded half up to the column's
    scale (whole numbers: 0), so that engines whose logarithm or cosine differ in the last bit agree.
    ``low`` and ``high`` move what lies outside onto the bound."""
    u, v = (ctx.draws[0] + F.lit(0.5)) / float(TWO32), ctx.draws[1] / float(TWO32)
    z = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)
    scale = _decimal_scale(p, ctx) if ctx.ctype.kind == "DECIMAL" else 0
    units = F.floor((F.lit(float(p["mean"])) + F.lit(float(p["std"])) * z) * float(10 ** scale) + 0.5).cast("long")
    if p.get("low") is not None or p.get("high") is not None:
        low, high = (None if p.get(k) is None else int(Decimal(str(p[k])).scaleb(scale)) for k in ("low", "high"))
        units = units if low is None else F.greatest(units, F.lit(low).cast("long"))
        units = units if high is None else F.least(units, F.lit(high).cast("long"))
    return units if scale == 0 else (units.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale)))


REGISTRY: dict[str, Generator] = {
    "serial": Generator("serial", lambda p: 0, _serial),
    "int_range": Generator("int_range", lambda p: _span_draws(_int_span(p)), _int_range),
    "categorical": Generator("categorical", lambda p: 1, _categorical),
    "decimal_range": Generator("decimal_range", _decimal_draws, _decimal_range),
    "date_range": Generator("date_range", lambda p: _span_draws(_date_days(p)), _date_range),
    "timestamp_range": Generator("timestamp_range", lambda p: _span_draws(_ts_span(p)),
                                 _timestamp_range),
    "faker": Generator("faker", _faker_draws, _faker),
    "normal": Generator("normal", lambda p: 2, _normal),
}


def register(kind: str, n_draws: Callable[[dict[str, Any]], int],
             build: Callable[[dict[str, Any], GenContext], Column],
             canonical_kinds: set[str] | None = None) -> None:
    """Add a generator kind: specs may name it from then on, for columns of ``canonical_kinds``
    (default: any)."""
    from ..plans.spec import GENERATOR_KINDS
    REGISTRY[kind] = Generator(kind, n_draws, build)
    GENERATOR_KINDS[kind] = set(canonical_kinds) if canonical_kinds else None


def null_mask(null_draw: Column, rate: float) -> Column:
    """True where the value is replaced by NULL."""
    return null_draw < F.lit(unit_cut(rate)).cast("long")
