"""Scalar expressions: typed, null instead of errors, exact decimals.

No expression throws: integer overflow and integer division by zero give null,
real division by zero NaN, and what a decimal cannot hold null."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DecimalScale, Refused, TypeMismatch
from ..types import DECIMAL_DIGITS, F64, I64, STR, Kind, ValueType, adapt, literal_kind, to_decimal
from . import patterns
from .predicates import Predicate, Scope, literal

#: The time zones that zone shifts know.
ZONES = (
    "America/Chicago", "America/Denver", "America/Los_Angeles", "America/New_York", "America/Phoenix",
    "Asia/Kathmandu", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney",
    "Europe/Berlin", "Europe/London", "Europe/Paris", "Pacific/Auckland", "UTC",
)
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
MIN64, MAX64 = -(1 << 63), (1 << 63) - 1


class Scalar:
    def kind(self, scope: Scope) -> Kind | None:
        """The kind of the result; None for a bare null."""
        raise NotImplementedError

    def column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def bits(self, scope: Scope) -> int | None:
        """How many bits, with the sign, an integer result needs at the most;
        None where that is not known."""
        return None

    def parts(self) -> tuple:
        return ()

    def refs(self) -> set[str]:
        return set().union(*(p.refs() for p in self.parts()))

    def __add__(self, other):
        return Arithmetic("+", self, wrap(other))

    def __sub__(self, other):
        return Arithmetic("-", self, wrap(other))

    def __mul__(self, other):
        return Arithmetic("*", self, wrap(other))

    def __truediv__(self, other):
        return Arithmetic("/", self, wrap(other))


def wrap(x: Any) -> Scalar:
    return x if isinstance(x, Scalar) else Lit(x)


@dataclass(frozen=True)
class Col(Scalar):
    name: str

    def kind(self, scope):
        return scope.kind(self.name)

    def column(self, scope):
        return scope.column(self.name)

    def bits(self, scope):
        return scope.bits.get(self.name)

    def refs(self):
        return {self.name}


@dataclass(frozen=True)
class Lit(Scalar):
    value: Any

    def kind(self, scope):
        return literal_kind(self.value)

    def bits(self, scope):
        return self.value.bit_length() + 1 if isinstance(self.value, int) and not isinstance(self.value, bool) else None

    def column(self, scope):
        kind = self.kind(scope)
        return F.lit(None) if kind is None else literal(self.value, kind)


def _units(c: Column, scale: int) -> Column:
    return (c * F.lit(10**scale).cast("decimal(19,0)")).cast("decimal(38,0)")


def _decimal(units: Column, scale: int) -> Column:
    """Units back as a decimal, null beyond 64 bits."""
    fits = (units >= F.lit(str(MIN64)).cast("decimal(38,0)")) & (units <= F.lit(str(MAX64)).cast("decimal(38,0)"))
    value = F.when(fits, units.cast("decimal(19,0)")) * F.lit("1e-%d" % scale).cast(f"decimal({max(scale, 1)},{scale})")
    return value.try_cast(f"decimal({DECIMAL_DIGITS},{scale})")


def _int_div(a: Column, b: Column, low: Column) -> Column:
    guarded = F.when((b != 0) & ~((a == low) & (b == -1)), b)
    return F.call_function("div", a, guarded)


@dataclass(frozen=True)
class Arithmetic(Scalar):
    op: str
    left: Scalar
    right: Scalar

    def parts(self):
        return (self.left, self.right)

    def _kinds(self, scope) -> tuple[Kind, Kind]:
        a, b = self.left.kind(scope), self.right.kind(scope)
        a, b = a or b or I64, b or a or I64
        # a literal beside a decimal takes its scale for sums
        if self.op in "+-":
            if a.type is ValueType.DECIMAL and isinstance(self.right, Lit) and b.type in (ValueType.I64, ValueType.DECIMAL):
                to_decimal(self.right.value, a.scale) if self.right.value is not None else None
                b = a
            elif b.type is ValueType.DECIMAL and isinstance(self.left, Lit) and a.type in (ValueType.I64, ValueType.DECIMAL):
                to_decimal(self.left.value, b.scale) if self.left.value is not None else None
                a = b
        return a, b

    def kind(self, scope):
        a, b = self._kinds(scope)
        dec = [k for k in (a, b) if k.type is ValueType.DECIMAL]
        if not dec:
            return I64 if a.integer and b.integer else F64
        if F64 in (a, b):
            raise DecimalScale("a decimal does not mix with a double")
        if self.op in "+-":
            if a != b:
                raise DecimalScale(f"decimals are only added at one scale, and to decimals: {a} and {b}")
            return a
        if self.op == "*":
            if len(dec) == 2:
                raise DecimalScale("a decimal times a decimal has another scale")
            if not (a.integer or b.integer):
                raise DecimalScale("a decimal is multiplied by an integer only")
            return dec[0]
        if a.type is not ValueType.DECIMAL or not b.integer:
            raise DecimalScale("a decimal is divided by an integer only, and divides nothing")
        return a

    def bits(self, scope):
        a, b = self.left.bits(scope), self.right.bits(scope)
        if a is None or b is None or self.op == "/" or self.kind(scope) != I64:
            return None
        n = a + b if self.op == "*" else max(a, b) + 1
        return n if n <= 64 else None

    def column(self, scope):
        kind, (a, b) = self.kind(scope), self._kinds(scope)
        x, y = self.left.column(scope), self.right.column(scope)
        if kind.type is ValueType.DECIMAL:
            s = kind.scale
            x = _units(x.cast(kind.spark()), s) if a.type is ValueType.DECIMAL else x.cast("decimal(19,0)")
            y = _units(y.cast(kind.spark()), s) if b.type is ValueType.DECIMAL else y.cast("decimal(19,0)")
            if self.op == "/":
                q = F.call_function("div", x, F.when(y != 0, y)).cast("decimal(38,0)")
                return _decimal(q, s)
            if self.op == "*":
                return _decimal(F.try_multiply(x.cast("decimal(19,0)"), y.cast("decimal(19,0)")).cast("decimal(38,0)"), s)
            return _decimal((x + y if self.op == "+" else x - y).cast("decimal(38,0)"), s)
        if not (a.numeric and b.numeric):
            return F.lit(None).cast(kind.spark())
        if kind == I64:
            x, y = x.cast("bigint"), y.cast("bigint")
            if self.op == "/":
                return _int_div(x, y, F.lit(MIN64))
            if self.bits(scope):  # cannot overflow
                return x + y if self.op == "+" else x - y if self.op == "-" else x * y
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[self.op](x, y)
        x, y = x.cast("double"), y.cast("double")
        if self.op == "/":
            return F.when(y.isNull() | x.isNull(), F.lit(None).cast("double")).when(y == 0, float("nan")).otherwise(x / F.when(y != 0, y))
        return {"+": x + y, "-": x - y, "*": x * y}[self.op]


def _typed_null(kind: Kind) -> Column:
    return F.lit(None).cast(kind.spark())


@dataclass(frozen=True)
class Text(Scalar):
    """length, lower or upper."""

    name: str
    of: Scalar

    def parts(self):
        return (self.of,)

    def kind(self, scope):
        k = self.of.kind(scope)
        if k and k.type is ValueType.DECIMAL:
            raise DecimalScale(f"{self.name} takes no decimal")
        return I64 if self.name == "length" else STR

    def column(self, scope):
        own, k, c = self.kind(scope), self.of.kind(scope), self.of.column(scope)
        if k == STR:
            return F.char_length(c).cast("bigint") if self.name == "length" else F.lower(c) if self.name == "lower" else F.upper(c)
        if k and k.type is ValueType.BYTES and self.name == "length":
            return F.octet_length(c).cast("bigint")
        return _typed_null(own)


@dataclass(frozen=True)
class Concat(Scalar):
    of: tuple[Scalar, ...]

    def parts(self):
        return self.of

    def kind(self, scope):
        for p in self.of:
            p.kind(scope)
        return STR

    def column(self, scope):
        out = []
        for p in self.of:
            k, c = p.kind(scope), p.column(scope)
            if k is None or k.type in (ValueType.BYTES, ValueType.VECTOR, ValueType.DECIMAL, ValueType.ARRAY):
                return _typed_null(STR)
            out.append(F.regexp_replace(c.cast("string"), r"\.0$", "") if k == F64 else c.cast("string"))
        return F.concat(*out)


def _needs_seconds(scalar: Scalar, scope: Scope, what: str) -> Column:
    k = scalar.kind(scope)
    if k and not k.integer:
        raise TypeMismatch(f"{what} needs integer seconds, not a {k.type.value}")
    return scalar.column(scope).cast("bigint")


@dataclass(frozen=True)
class Time(Scalar):
    """Parts and starts of seconds since the epoch, as integers."""

    name: str  # extract, trunc, part, start, zone, offset
    unit: Any
    of: Scalar

    def parts(self):
        return (self.of,)

    def kind(self, scope):
        _needs_seconds(self.of, scope, self.name)
        return I64

    def column(self, scope):
        t = _needs_seconds(self.of, scope, self.name)
        if self.name in ("extract", "trunc"):
            unit = F.lit(UNITS[self.unit]).cast("bigint")
            start = t - F.pmod(t, unit)
            within = {"second": 60, "minute": 60, "hour": 24, "day": 0}[self.unit]
            if self.name == "trunc":
                return start
            whole = F.call_function("div", start, unit)
            return F.pmod(whole, F.lit(within).cast("bigint")) if within else whole
        if self.name == "offset":
            return F.try_add(t, F.lit(self.unit).cast("bigint"))
        ts = F.timestamp_seconds(t)
        if self.name == "zone":
            return F.unix_seconds(F.from_utc_timestamp(ts, self.unit)) if self.unit in ZONES else _typed_null(I64)
        if self.name == "start":
            return F.unix_seconds(F.date_trunc(self.unit, ts))
        part = {"year": F.year(ts), "month": F.month(ts), "day_of_month": F.dayofmonth(ts), "day_of_week": F.dayofweek(ts) - 1}
        return part[self.unit].cast("bigint")


@dataclass(frozen=True)
class Round(Scalar):
    of: Scalar

    def parts(self):
        return (self.of,)

    def kind(self, scope):
        k = self.of.kind(scope)
        if k and k.type is ValueType.DECIMAL:
            raise DecimalScale("round takes no decimal")
        return I64

    def column(self, scope):
        k, c = self.of.kind(scope), self.of.column(scope)
        self.kind(scope)
        if k and k.integer:
            return c.cast("bigint")
        if k != F64:
            return _typed_null(I64)
        x = c.cast("double")
        r = F.when(F.isnan(x), F.lit(None)).when(x >= float(MAX64), F.lit(MAX64)).when(x <= float(MIN64), F.lit(MIN64))
        return r.otherwise(F.round(F.when((x < float(MAX64)) & (x > float(MIN64)), x)).try_cast("bigint"))


@dataclass(frozen=True)
class Case(Scalar):
    branches: tuple[tuple[Predicate, Scalar], ...]
    otherwise: Scalar

    def parts(self):
        return (*(s for _, s in self.branches), self.otherwise)

    def refs(self):
        return super().refs().union(*(p.refs() for p, _ in self.branches))

    def kind(self, scope):
        return _common(self.parts(), scope)

    def column(self, scope):
        kind, out = self.kind(scope), F
        for p, s in self.branches:
            out = out.when(p.column(scope), _as(s, kind, scope))
        return out.otherwise(_as(self.otherwise, kind, scope))


@dataclass(frozen=True)
class Coalesce(Scalar):
    of: tuple[Scalar, ...]

    def parts(self):
        return self.of

    def kind(self, scope):
        return _common(self.of, scope)

    def column(self, scope):
        kind = self.kind(scope)
        return F.coalesce(*[_as(s, kind, scope) for s in self.of])


def _as(s: Scalar, kind: Kind | None, scope: Scope) -> Column:
    if kind and isinstance(s, Lit) and s.value is not None:
        return literal(adapt(s.value, kind), kind)
    return s.column(scope).cast(kind.spark()) if kind else s.column(scope)


def _common(parts: tuple[Scalar, ...], scope: Scope) -> Kind | None:
    """The one kind of all branches; literals take that of the others."""
    kinds = [k for p in parts if not isinstance(p, Lit) and (k := p.kind(scope))] or [k for p in parts if (k := p.kind(scope))]
    first = kinds[0] if kinds else None
    for k in kinds:
        if not k.matches(first):
            error = DecimalScale if ValueType.DECIMAL in (k.type, first.type) else TypeMismatch
            raise error(f"branches of two kinds: {first.type.value} and {k.type.value}")
    for p in parts:
        if isinstance(p, Lit) and first:
            adapt(p.value, first)
    return first


METRICS = ("l2", "l2_squared", "cosine", "negative_inner_product")


@dataclass(frozen=True)
class Distance(Scalar):
    metric: str
    left: Scalar
    right: Scalar

    def parts(self):
        return (self.left, self.right)

    def kind(self, scope):
        if self.metric not in METRICS:
            raise Refused(f"no distance {self.metric}; there are {', '.join(METRICS)}")
        for p in self.parts():
            k = p.kind(scope)
            if k and k.type is not ValueType.VECTOR:
                raise TypeMismatch(f"a distance needs vectors, not a {k.type.value}")
        return F64

    def column(self, scope):
        self.kind(scope)
        a, b = (p.column(scope).cast("array<double>") for p in self.parts())
        total = lambda x, y, f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)
        if self.metric == "negative_inner_product":
            out = -total(a, b, lambda x, y: x * y)
        elif self.metric == "cosine":
            size = F.sqrt(total(a, a, lambda x, y: x * y)) * F.sqrt(total(b, b, lambda x, y: x * y))
            out = 1 - total(a, b, lambda x, y: x * y) / F.when(size != 0, size)
        else:
            out = total(a, b, lambda x, y: (x - y) * (x - y))
            out = F.sqrt(out) if self.metric == "l2" else out
        return F.when(F.size(a) == F.size(b), out)


@dataclass(frozen=True)
class RegexpReplace(Scalar):
    of: Scalar
    pattern: str
    by: str

    def parts(self):
        return (self.of,)

    def kind(self, scope):
        if self.of.kind(scope) not in (None, STR):
            raise TypeMismatch("regexp_replace needs a string")
        return STR

    def column(self, scope):
        self.kind(scope)
        p = patterns.regex(self.pattern)
        return _typed_null(STR) if p is None else F.regexp_replace(self.of.column(scope), F.lit(p), F.lit(patterns.replacement(self.by, patterns.groups(p))))


@dataclass(frozen=True)
class Truth(Scalar):
    """A predicate as a value."""

    of: Predicate

    def kind(self, scope):
        return Kind(ValueType.BOOL)

    def column(self, scope):
        return self.of.column(scope)

    def refs(self):
        return self.of.refs()


# --- how expressions are written ---


def col(name: str) -> Scalar:
    return Col(name)


def lit(value: Any) -> Scalar:
    return Lit(value)


def length(x) -> Scalar:
    return Text("length", _named(x))


def lower(x) -> Scalar:
    return Text("lower", _named(x))


def upper(x) -> Scalar:
    return Text("upper", _named(x))


def concat(*xs) -> Scalar:
    return Concat(tuple(map(wrap, xs)))


def _named(x) -> Scalar:
    return Col(x) if isinstance(x, str) else x


def extract(unit: str, x) -> Scalar:
    """second, minute, hour of the day, or whole days since the epoch."""
    return Time("extract", _unit(unit, UNITS), _named(x))


def date_trunc(unit: str, x) -> Scalar:
    return Time("trunc", unit, _named(x)) if unit in UNITS else calendar_trunc(unit, x)


def calendar_part(part: str, x) -> Scalar:
    """year, month, day_of_month, or day_of_week with Sunday as 0, in UTC."""
    return Time("part", _unit(part, ("year", "month", "day_of_month", "day_of_week")), _named(x))


def calendar_trunc(unit: str, x) -> Scalar:
    return Time("start", _unit(unit, ("month", "year")), _named(x))


def zone_shift(zone: str, x) -> Scalar:
    """Local seconds in a zone; an unknown zone gives null."""
    return Time("zone", zone, _named(x))


def offset(text: str, x) -> Scalar:
    """Seconds shifted by a fixed offset such as -05:00."""
    m = re.fullmatch(r"([+-])(\d\d):(\d\d)", text)
    if not m or int(m[2]) > 18 or int(m[3]) > 59:
        raise Refused(f"{text} is no offset")
    return Time("offset", (int(m[2]) * 3600 + int(m[3]) * 60) * (-1 if m[1] == "-" else 1), _named(x))


def _unit(unit: str, known) -> str:
    if unit not in known:
        raise Refused(f"{unit} is none of {', '.join(known)}")
    return unit


def round_(x) -> Scalar:
    return Round(_named(x))


def case(branches, otherwise=None) -> Scalar:
    return Case(tuple((p, wrap(s)) for p, s in branches), wrap(otherwise))


def coalesce(*xs) -> Scalar:
    return Coalesce(tuple(map(wrap, xs)))


def distance(metric: str, a, b) -> Scalar:
    return Distance(metric, _named(a), Lit(list(map(float, b))) if isinstance(b, (list, tuple)) else _named(b))


def regexp_replace(x, pattern: str, by: str) -> Scalar:
    return RegexpReplace(_named(x), pattern, by)
