"""Query specifications: plain values, built by chaining, by names."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from ..errors import Refused
from ..functions.predicates import TRUE, And, Predicate
from ..functions.scalars import Scalar

ALL, NONE = "*", ()


@dataclass(frozen=True)
class Sort:
    """By default nulls are first ascending and last descending; where they
    are placed is absolute, not turned round with the direction."""

    name: str
    descending: bool = False
    nulls: str | None = None  # first or last


def asc(name: str, nulls: str | None = None) -> Sort:
    return Sort(name, False, nulls)


def desc(name: str, nulls: str | None = None) -> Sort:
    return Sort(name, True, nulls)


@dataclass(frozen=True)
class Agg:
    name: str  # of the result
    function: str  # count, count_column, min, max, sum, avg, count_distinct
    column: str | None = None

    @staticmethod
    def count(name: str = "count") -> Agg:
        return Agg(name, "count")

    @staticmethod
    def count_column(column: str, name: str | None = None) -> Agg:
        return Agg(name or f"count_{column}", "count_column", column)

    @staticmethod
    def min(column: str, name: str | None = None) -> Agg:
        return Agg(name or f"min_{column}", "min", column)

    @staticmethod
    def max(column: str, name: str | None = None) -> Agg:
        return Agg(name or f"max_{column}", "max", column)

    @staticmethod
    def sum(column: str, name: str | None = None) -> Agg:
        return Agg(name or f"sum_{column}", "sum", column)

    @staticmethod
    def avg(column: str, name: str | None = None) -> Agg:
        return Agg(name or f"avg_{column}", "avg", column)

    @staticmethod
    def count_distinct(column: str, name: str | None = None) -> Agg:
        return Agg(name or f"count_distinct_{column}", "count_distinct", column)


@dataclass(frozen=True)
class Window:
    """A ranking, a neighbour's value, or an aggregate, over a partition. An
    aggregate with an order runs up to the current row and its peers."""

    name: str
    function: str  # row_number, rank, dense_rank, lag, lead, or an aggregate's
    column: str | None = None
    by: int = 1
    partition: tuple[str, ...] = ()
    order: tuple[Sort, ...] = ()

    def over(self, partition=(), order=()) -> Window:
        return replace(self, partition=tuple(partition), order=tuple(Sort(o) if isinstance(o, str) else o for o in order))

    @staticmethod
    def row_number(name: str) -> Window:
        return Window(name, "row_number")

    @staticmethod
    def rank(name: str) -> Window:
        return Window(name, "rank")

    @staticmethod
    def dense_rank(name: str) -> Window:
        return Window(name, "dense_rank")

    @staticmethod
    def lag(name: str, column: str, by: int = 1) -> Window:
        return Window(name, "lag", column, by)

    @staticmethod
    def lead(name: str, column: str, by: int = 1) -> Window:
        return Window(name, "lead", column, by)

    @staticmethod
    def aggregate(agg: Agg) -> Window:
        return Window(agg.name, agg.function, agg.column)


@dataclass(frozen=True)
class Query:
    table: str
    filter: Predicate = TRUE
    computed: tuple[tuple[str, Scalar], ...] = ()
    projection: Any = ALL
    windows: tuple[Window, ...] = ()
    order: tuple[Sort, ...] = ()
    most: int | None = None
    skip: int = 0
    cursor: tuple | None = None
    paged: bool = False
    descending: bool = False  # the direction of a scan by key
    index: str | None = None  # advice
    deleted: bool = False

    def where(self, p: Predicate) -> Query:
        return replace(self, filter=p if self.filter == TRUE else And((self.filter, p)))

    def compute(self, name: str, scalar: Scalar) -> Query:
        return replace(self, computed=(*self.computed, (name, scalar)))

    def select(self, *names: str) -> Query:
        return replace(self, projection=names)

    def select_all(self) -> Query:
        return replace(self, projection=ALL)

    def select_none(self) -> Query:
        return replace(self, projection=NONE)

    def window(self, w: Window) -> Query:
        return replace(self, windows=(*self.windows, w))

    def sort(self, *order: Sort | str) -> Query:
        return replace(self, order=tuple(Sort(o) if isinstance(o, str) else o for o in order))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def after(self, *key: Any) -> Query:
        """The next page: rows whose key comes after this one."""
        return replace(self, cursor=key, paged=True)

    def paging(self) -> Query:
        return replace(self, paged=True)

    def reversed(self) -> Query:
        return replace(self, descending=True)

    def using_index(self, name: str) -> Query:
        return replace(self, index=name)

    def using_table_scan(self) -> Query:
        return replace(self, index="")

    def include_deleted(self) -> Query:
        return replace(self, deleted=True)


@dataclass(frozen=True)
class Grouping:
    keys: tuple[str, ...] = ()
    aggregates: tuple[Agg, ...] = ()
    having_: Predicate = TRUE
    order: tuple[Sort, ...] = ()
    most: int | None = None
    skip: int = 0

    def group_by(self, *keys: str) -> Grouping:
        return replace(self, keys=(*self.keys, *keys))

    def aggregate(self, *aggs: Agg) -> Grouping:
        return replace(self, aggregates=(*self.aggregates, *aggs))

    def having(self, p: Predicate) -> Grouping:
        return replace(self, having_=p if self.having_ == TRUE else And((self.having_, p)))

    def sort(self, *order: Sort | str) -> Grouping:
        return replace(self, order=tuple(Sort(o) if isinstance(o, str) else o for o in order))

    def limit(self, n: int) -> Grouping:
        return replace(self, most=n)

    def offset(self, n: int) -> Grouping:
        return replace(self, skip=n)


HOWS = ("inner", "left", "right", "full")
ALGORITHMS = {"hash": "shuffle_hash", "broadcast": "broadcast", "merge": "merge", "nested_loop": None}


@dataclass(frozen=True)
class Step:
    """One table joined to those before it. ``on``: pairs (earlier, own) of
    column names; ``residual``: a further ON condition over both sides."""

    query: Query
    on: tuple[tuple[str, str], ...]
    how: str = "inner"
    alias: str | None = None
    residual: Predicate = TRUE
    algorithm: str | None = None


@dataclass(frozen=True)
class Chain:
    """Two or more tables joined in written order. Columns are named
    ``alias.column``, or bare; joined rows carry bare names, with the alias in
    front (``alias_column``) where two tables share one."""

    first: Query
    alias: str | None = None
    steps: tuple[Step, ...] = ()
    computed: tuple[tuple[str, Scalar], ...] = ()
    most: int | None = None
    skip: int = 0
    paged: bool = False

    def join(self, query: Query, on, how: str = "inner", alias: str | None = None, having: Predicate = TRUE, using: str | None = None) -> Chain:
        if how not in HOWS:
            raise Refused(f"no {how} join; there are {', '.join(HOWS)}")
        on = tuple((k, k) if isinstance(k, str) else tuple(k) for k in ([on] if isinstance(on, str) else on))
        if not on:
            raise Refused("a join needs at least one equality; a cross join is not offered")
        if using is not None and using not in ALGORITHMS:
            raise Refused(f"no algorithm {using}; there are {', '.join(ALGORITHMS)}")
        if using == "nested_loop" and how in ("right", "full"):
            raise Refused(f"a nested loop cannot keep the unmatched rows of a {how} join")
        return replace(self, steps=(*self.steps, Step(query, on, how, alias, having, using)))

    def compute(self, name: str, scalar: Scalar) -> Chain:
        return replace(self, computed=(*self.computed, (name, scalar)))

    def limit(self, n: int) -> Chain:
        return replace(self, most=n)

    def offset(self, n: int) -> Chain:
        return replace(self, skip=n)

    def paging(self) -> Chain:
        """Pages of the first table's rows, each with all it joins to."""
        return replace(self, paged=True)


def join(left: Query, right: Query, on, how: str = "inner", aliases=(None, None), **options) -> Chain:
    return Chain(left, aliases[0]).join(right, on, how, aliases[1], **options)
