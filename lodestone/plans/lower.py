"""Specifications to DataFrames. Everything stays lazy; Catalyst plans it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NoSuchColumn, Refused, TypeMismatch
from ..functions.predicates import TRUE, InQuery, Predicate, Scope, conjuncts
from ..functions.scalars import Arithmetic, Col, Lit
from ..operators.aggregates import aggregate, result_kind, shifted_sum
from ..operators.ordering import after, order_columns
from ..operators.windows import window
from ..types import I64, kind_of
from .spec import ALGORITHMS, ALL, Chain, Grouping, Query, Sort, Step


#: Bits of Spark's narrower integers; wider ones may say in their metadata.
_BITS = {"byte": 8, "short": 16, "integer": 32}


def _known_bits(fields) -> dict[str, int]:
    found = {f.name: f.metadata.get("bits") or _BITS.get(f.dataType.typeName()) for f in fields}
    return {n: b for n, b in found.items() if b}


def scope_of(df: DataFrame) -> Scope:
    fields = df.schema.fields
    return Scope({f.name: kind_of(f.dataType) for f in fields}, bits=_known_bits(fields))


def filtered(df: DataFrame, p: Predicate, run: Callable[[Query], DataFrame] | None = None, scope: Scope | None = None) -> DataFrame:
    """Rows for which ``p`` is True. Uncorrelated subqueries become semi and
    null-aware anti joins."""
    if p == TRUE:
        return df
    scope = scope or scope_of(df)
    plain = [q for q in conjuncts(p) if not isinstance(q, InQuery)]
    for q in plain:
        df = df.where(q.column(scope))
    for q in conjuncts(p):
        if isinstance(q, InQuery):
            df = _subquery(df, q, run, scope)
    return df


def _subquery(df: DataFrame, q: InQuery, run, scope: Scope) -> DataFrame:
    inner = run(q.query)
    if len(inner.columns) != 1:
        raise Refused("a subquery of IN has one column")
    own, other = scope.kind(q.name), kind_of(inner.schema.fields[0].dataType)
    if not own.matches(other):
        raise TypeMismatch(f"{q.name} is a {own.type.value} and the subquery gives a {other.type.value}")
    name = scope.columns.get(q.name, q.name)
    view = inner.toDF("_v").distinct()
    if not q.negated:
        return df.join(view, F.col(f"`{name}`") == F.col("_v"), "left_semi")
    # NOT IN is null-aware: a null among the values leaves nothing, and a null
    # on the left stays only if there are no values
    facts = F.broadcast(view.agg(F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_k")))
    rest = df.join(view.where("_v is not null"), F.col(f"`{name}`") == F.col("_v"), "left_anti")
    return rest.join(facts, (F.col("_n") == 0) | ((F.col("_n") == F.col("_k")) & F.col(f"`{name}`").isNotNull()), "left_semi")


def computed(df: DataFrame, scalars, scope: Scope | None = None) -> DataFrame:
    """Add values in order; one may use those before it, not those after. What
    doesn't use one another is added in one projection."""
    later, seen = [n for n, _ in scalars], set(df.columns)
    for i, (name, s) in enumerate(scalars):
        if name in seen:
            raise Refused(f"there is a column {name} already")
        ahead = s.refs() & set(later[i:])
        if ahead:
            raise Refused(f"{name} uses {', '.join(sorted(ahead))}, computed later")
        seen.add(name)
    rest = list(scalars)
    while rest:
        now, layer = scope or scope_of(df), {}
        while rest and not rest[0][1].refs() & layer.keys():
            name, s = rest.pop(0)
            s.kind(now)
            bits = s.bits(now)
            layer[name] = s.column(now).alias(name, metadata={"bits": bits}) if bits else s.column(now)
        df = df.withColumns(layer)
        if scope:
            scope.bits |= {n: b for n, b in _known_bits(df.schema.fields).items() if n in layer}
            scope.kinds |= {n: kind_of(f.dataType) for n, f in zip(df.columns, df.schema.fields, strict=True) if n in layer}
    return df


def query(df: DataFrame, q: Query, key: tuple[str, ...], run=None) -> DataFrame:
    """One table, secured already: computes, filter, windows, order, page,
    limit, projection."""
    if q.paged:
        if q.order and [s.name for s in q.order] != list(key)[: len(q.order)]:
            raise Refused("pages come in the order of the key")
        if q.windows:
            raise Refused("a window sees all rows, a page does not")
        if q.skip:
            raise Refused("a page has no offset; it comes after a key")
    df = computed(df, q.computed)
    df = filtered(df, q.filter, run)
    scope = scope_of(df)
    if q.paged and q.cursor is not None:
        df = df.where(after(key, q.cursor, scope, q.descending))
    for w in q.windows:
        if w.name in df.columns:
            raise Refused(f"there is a column {w.name} already")
    if q.windows:
        df = df.withColumns({w.name: window(w, scope, list(key)) for w in q.windows})
        scope = scope_of(df)
    df = ordered(df, q.order, scope, q.most, q.skip, [Sort(k, q.descending) for k in key], q.descending or q.paged)
    if q.projection == ALL:
        return df
    for n in q.projection:
        scope.kind(n)
    return df.select(*[F.col(f"`{n}`") for n in q.projection])


def ordered(df: DataFrame, order, scope: Scope, most: int | None, skip: int, ties: list[Sort], always: bool = False) -> DataFrame:
    """Sort, then skip, then take. Where rows are cut the ties are broken by
    key, so that the same rows come each time."""
    cut = most is not None or skip
    if order or cut or always:
        named = {s.name for s in order}
        full = (*order, *(t for t in ties if t.name not in named)) if cut or always else order
        if full:
            df = df.orderBy(*order_columns(tuple(full), scope))
    if skip:
        df = df.offset(skip)
    return df if most is None else df.limit(most)


def shifted_sums(q: Query, g: Grouping, bits: dict[str, int]) -> dict[str, tuple[str, int]]:
    """Values of a query that are an integer column plus a literal and that
    nothing but sums ask for, as (column, literal): sum(c + k) is
    sum(c) + k count(c), so that all such sums share one. ``bits``: of columns;
    only such as cannot overflow are taken."""
    out = {}
    for name, s in q.computed:
        if isinstance(s, Arithmetic) and s.op in "+-" and isinstance(s.left, Col) and isinstance(s.right, Lit) and s.left.name in bits:
            own = s.bits(Scope({s.left.name: I64}, bits=bits)) if type(s.right.value) is int else None
            if own and own <= 34:
                out[name] = (s.left.name, s.right.value if s.op == "+" else -s.right.value)
    used = set(q.filter.refs()).union(g.keys, *(s.refs() for _, s in q.computed), (a.column for a in g.aggregates if a.function != "sum"))
    return {n: x for n, x in out.items() if n not in used}


def grouped(df: DataFrame, g: Grouping, scope: Scope | None = None, shifted: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Hash aggregation, HAVING, ORDER BY, OFFSET and LIMIT, in that order.
    Null is a key; without keys there is one row, over no rows too. ``shifted``:
    see ``shifted_sums``."""
    scope, shifted = scope or scope_of(df), shifted or {}
    scope = Scope(scope.kinds | {n: scope.kind(c) for n, (c, _) in shifted.items()}, scope.columns, scope.bits)
    aggs = [(shifted_sum(scope, *shifted[a.column]) if a.column in shifted else aggregate(a, scope)).alias(a.name) for a in g.aggregates]
    names = [*g.keys, *(a.name for a in g.aggregates)]
    if len(set(names)) < len(names):
        raise Refused("two results of one name")
    keys = [scope.column(k).alias(k) for k in g.keys]
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    kinds = {k: scope.kind(k) for k in g.keys} | {a.name: result_kind(a, scope) for a in g.aggregates}
    own = Scope(kinds)
    for ref in g.having_.refs():
        own.kind(ref)
    if g.having_ != TRUE:
        out = out.where(g.having_.column(own))
    return ordered(out, g.order, own, g.most, g.skip, [Sort(k) for k in g.keys])


class Joined:
    """A chain's rows and its names: bare and with the alias."""

    def __init__(self, df: DataFrame, scope: Scope, ambiguous: dict[str, str]):
        self.df, self.scope, self.ambiguous = df, scope, ambiguous

    def warn(self, refs: set[str]) -> list[str]:
        return [f"{r} stands in several tables; {self.ambiguous[r]} is meant" for r in sorted(refs) if r in self.ambiguous]


def chain(c: Chain, run: Callable[[Query], DataFrame], key_of: Callable[[str], tuple[str, ...]]) -> Joined:
    """The joined rows, without limit, with computed values."""
    if not c.steps:
        raise Refused("a join has two tables at least")
    queries = [c.first, *(s.query for s in c.steps)]
    aliases = [c.alias or c.first.table, *(s.alias or s.query.table for s in c.steps)]
    if len(set(aliases)) < len(aliases):
        raise Refused("a table joined twice needs an alias")
    if c.paged:
        if c.most is not None or c.skip:
            raise Refused("a page's limit is that of its first table")
        if c.first.most is None:
            raise Refused("a page of a join needs a limit")
        if any(s.how in ("right", "full") for s in c.steps):
            raise Refused("right and full joins cannot be paged")
        queries[0] = c.first.paging()
    frames = [run(q) for q in queries]
    names: dict[str, list[int]] = {}
    for i, df in enumerate(frames):
        for n in df.columns:
            names.setdefault(n, []).append(i)
    kinds, columns, ambiguous, bits = {}, {}, {}, {}
    for i, df in enumerate(frames):
        out, known_bits = [], _known_bits(df.schema.fields)
        for f in df.schema.fields:
            final = f.name if len(names[f.name]) == 1 else f"{aliases[i]}_{f.name}"
            out.append(F.col(f"`{f.name}`").alias(final))
            kinds[f"{aliases[i]}.{f.name}"], columns[f"{aliases[i]}.{f.name}"] = kind_of(f.dataType), final
            if f.name not in kinds:
                kinds[f.name], columns[f.name] = kind_of(f.dataType), final
            elif len(names[f.name]) > 1:
                ambiguous[f.name] = f"{aliases[names[f.name][0]]}.{f.name}"
            kinds[final], columns[final] = kind_of(f.dataType), final
            bits |= {n: known_bits[f.name] for n in (f"{aliases[i]}.{f.name}", final) if f.name in known_bits}
        frames[i] = df.select(*out)
    scope, df = Scope(kinds, columns, bits), frames[0]
    known = set(aliases[:1])
    for alias, right, step in zip(aliases[1:], frames[1:], c.steps, strict=True):
        df = _step(df, right, step, scope, alias, known)
        known.add(alias)
    df = computed(df, c.computed, scope) if c.computed else df
    return Joined(df, scope, ambiguous)


def _step(df: DataFrame, right: DataFrame, step: Step, scope: Scope, alias: str, known: set[str]) -> DataFrame:
    condition: Column | None = None
    for early, own in step.on:
        own = own if "." in own else f"{alias}.{own}"
        if "." in early and early.split(".")[0] not in known:
            raise NoSuchColumn(f"{early} is of no earlier table")
        if scope.columns.get(early, early) not in df.columns:
            raise NoSuchColumn(f"{early} is a column of no earlier table")
        a, b = scope.kind(early), scope.kind(own)
        if not a.matches(b):
            raise TypeMismatch(f"{early} is a {a.type.value} and {own} a {b.type.value}; they are not joined")
        equal = df[f"`{scope.columns[early]}`"] == right[f"`{scope.columns[own]}`"]
        condition = equal if condition is None else condition & equal
    if step.residual != TRUE:
        condition = condition & step.residual.column(scope)
    hint = ALGORITHMS.get(step.algorithm)
    return df.join(right.hint(hint) if hint else right, condition, step.how)


def cut(j: Joined, c: Chain) -> DataFrame:
    df = j.df
    if c.skip:
        df = df.offset(c.skip)
    return df if c.most is None else df.limit(c.most)


