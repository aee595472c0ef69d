"""Predicates over rows, in three-valued logic: only True admits a row."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InListTooLarge, NoSuchColumn, Refused, TypeMismatch
from ..types import STR, Kind, ValueType, adapt
from . import patterns, text

#: Values that an IN list may have.
MOST_IN = 10_000
OPERATORS = {"=": "eq", "<>": "ne", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


class Scope:
    """Names that an expression may use: their kinds and Spark columns, and of
    integers how many bits they need at the most, where that is known."""

    def __init__(self, kinds: dict[str, Kind], columns: dict[str, str] | None = None, bits: dict[str, int] | None = None):
        self.kinds, self.columns, self.bits = kinds, columns or {}, bits or {}

    def kind(self, name: str) -> Kind:
        if name not in self.kinds:
            raise NoSuchColumn(f"there is no column {name} here; there are {', '.join(self.kinds)}")
        return self.kinds[name]

    def column(self, name: str) -> Column:
        self.kind(name)
        return F.col(f"`{self.columns.get(name, name)}`")


class Predicate:
    def column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def refs(self) -> set[str]:
        return set()

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


def literal(value: Any, kind: Kind) -> Column:
    value = adapt(value, kind)
    if isinstance(value, (list, tuple)):
        return F.array(*map(F.lit, value)).cast(kind.spark())
    return F.lit(value).cast(kind.spark()) if value is None or kind.type in (ValueType.DECIMAL, ValueType.F64) else F.lit(value)


def _compared(op: str, a: Column, b: Column) -> Column:
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[OPERATORS[op]]


@dataclass(frozen=True)
class Compare(Predicate):
    name: str
    op: str
    value: Any

    def column(self, scope: Scope) -> Column:
        return _compared(self.op, scope.column(self.name), literal(self.value, scope.kind(self.name)))

    def refs(self) -> set[str]:
        return {self.name}


@dataclass(frozen=True)
class CompareColumns(Predicate):
    left: str
    op: str
    right: str

    def column(self, scope: Scope) -> Column:
        a, b = scope.kind(self.left), scope.kind(self.right)
        if not a.matches(b):
            raise TypeMismatch(f"{self.left} is a {a.type.value} and {self.right} a {b.type.value}; they are not compared")
        return _compared(self.op, scope.column(self.left), scope.column(self.right))

    def refs(self) -> set[str]:
        return {self.left, self.right}


@dataclass(frozen=True)
class IsNull(Predicate):
    name: str

    def column(self, scope: Scope) -> Column:
        return scope.column(self.name).isNull()

    def refs(self) -> set[str]:
        return {self.name}


def _needs_text(scope: Scope, name: str) -> Column:
    if scope.kind(name) != STR:
        raise TypeMismatch(f"{name} is a {scope.kind(name).type.value}; patterns need a string")
    return scope.column(name)


@dataclass(frozen=True)
class Like(Predicate):
    name: str
    pattern: str
    insensitive: bool = False

    def column(self, scope: Scope) -> Column:
        c, p = _needs_text(scope, self.name), patterns.like(self.pattern)
        return F.like(F.lower(c), F.lit(p.lower())) if self.insensitive else c.like(p)

    def refs(self) -> set[str]:
        return {self.name}


@dataclass(frozen=True)
class Matches(Predicate):
    """An unanchored search; a pattern that is none matches nothing."""

    name: str
    pattern: str
    insensitive: bool = False

    def column(self, scope: Scope) -> Column:
        c, p = _needs_text(scope, self.name), patterns.regex(self.pattern, self.insensitive)
        return F.when(c.isNotNull(), False) if p is None else c.rlike(p)

    def refs(self) -> set[str]:
        return {self.name}


@dataclass(frozen=True)
class Contains(Predicate):
    """All terms of the search stand in the text; no terms match nothing."""

    name: str
    query: str

    def column(self, scope: Scope) -> Column:
        c, wanted = _needs_text(scope, self.name), text.terms(self.query)
        if not wanted:
            return F.when(c.isNotNull(), False)
        return F.size(F.array_intersect(text.tokens(c), F.array(*map(F.lit, wanted)))) == F.when(c.isNotNull(), F.lit(len(wanted)))

    def refs(self) -> set[str]:
        return {self.name}


@dataclass(frozen=True)
class In(Predicate):
    name: str
    values: tuple

    def column(self, scope: Scope) -> Column:
        if len(self.values) > MOST_IN:
            raise InListTooLarge(f"an IN list of {len(self.values)} values; the most is {MOST_IN}")
        kind = scope.kind(self.name)
        if not self.values:
            return F.lit(False)
        return scope.column(self.name).isin([adapt(v, kind) for v in self.values])

    def refs(self) -> set[str]:
        return {self.name}


@dataclass(frozen=True)
class InQuery(Predicate):
    """``IN (SELECT column ...)``, uncorrelated. The engine resolves it to a
    join before rows are filtered (see ``plans.lower``)."""

    name: str
    query: Any
    negated: bool = False

    def column(self, scope: Scope) -> Column:
        raise Refused("IN (SELECT ...) stands only at the top of a filter, joined by AND")

    def refs(self) -> set[str]:
        return {self.name}


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, scope: Scope) -> Column:
        out = F.lit(True)
        for p in self.parts:
            out = out & p.column(scope)
        return out

    def refs(self) -> set[str]:
        return set().union(*(p.refs() for p in self.parts))


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, scope: Scope) -> Column:
        out = F.lit(False)
        for p in self.parts:
            out = out | p.column(scope)
        return out

    def refs(self) -> set[str]:
        return set().union(*(p.refs() for p in self.parts))


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def column(self, scope: Scope) -> Column:
        return ~self.part.column(scope)

    def refs(self) -> set[str]:
        return self.part.refs()


@dataclass(frozen=True)
class Const(Predicate):
    value: bool

    def column(self, scope: Scope) -> Column:
        return F.lit(self.value)


TRUE, FALSE = Const(True), Const(False)


def cmp(name: str, op: str, value: Any) -> Predicate:
    return Compare(name, op, value)


def columns(left: str, op: str, right: str) -> Predicate:
    return CompareColumns(left, op, right)


def is_null(name: str) -> Predicate:
    return IsNull(name)


def not_null(name: str) -> Predicate:
    return Not(IsNull(name))


def isin(name: str, values) -> Predicate:
    return In(name, tuple(values))


def conjuncts(p: Predicate) -> list[Predicate]:
    return [x for q in p.parts for x in conjuncts(q)] if isinstance(p, And) else [p]


# --- whether one predicate implies another, for partial materialisations ---


def implies(query: Predicate, goal: Predicate) -> bool:
    """Whether every row that ``query`` admits is sure to be admitted by
    ``goal``. False where it is not proved."""
    if query == goal or goal == TRUE or query == FALSE:
        return True
    if isinstance(goal, And):
        return all(implies(query, g) for g in goal.parts)
    if isinstance(query, Or):
        return all(implies(q, goal) for q in query.parts)
    if isinstance(goal, Or) and any(implies(query, g) for g in goal.parts):
        return True
    if isinstance(query, And):
        return any(implies(q, goal) for q in query.parts)
    if isinstance(goal, Not) and isinstance(goal.part, IsNull):
        told = (Compare, CompareColumns, Like, Matches, Contains, In)
        return isinstance(query, told) and goal.part.name in query.refs()
    if not isinstance(goal, Compare) or goal.value is None:
        return False
    if isinstance(query, Compare) and query.name == goal.name and query.value is not None:
        return _implied(OPERATORS[query.op], query.value, OPERATORS[goal.op], goal.value)
    if isinstance(query, In) and query.name == goal.name:
        return all(v is None or _implied("eq", v, OPERATORS[goal.op], goal.value) for v in query.values)
    return False


def _implied(op: str, v: Any, goal: str, g: Any) -> bool:
    """Whether x op v implies x goal g. Not told of NaN, which Python and the
    engine order differently."""
    if v != v or g != g:
        return False
    try:
        less, same = v < g, v == g
    except TypeError:
        return False
    more = not less and not same
    held = {
        "eq": {"eq": same, "ne": not same, "lt": less, "le": less or same, "gt": more, "ge": more or same},
        "ne": {"ne": same},
        "lt": {"lt": less or same, "le": less or same, "ne": less or same},
        "le": {"lt": less, "le": less or same, "ne": less},
        "gt": {"gt": more or same, "ge": more or same, "ne": more or same},
        "ge": {"gt": more, "ge": more or same, "ne": more},
    }
    return held[op].get(goal, False)
