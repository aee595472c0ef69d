"""The engine: tables, who may read them, and everything that can be asked."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .errors import NoSuchColumn, Refused
from .functions.language import as_predicate
from .functions.predicates import TRUE, And, InQuery, Predicate, conjuncts, implies
from .operators import statistics
from .plans import lower
from .plans.spec import Agg, Chain, Grouping, Query
from .schema import Catalog, TableDef, View, table_of
from .security import EXPLAIN, READ, ROOT, Context, Security
from .sources import VersionedTable
from .sources.tables import raw, time_bounds, with_epoch_seconds


@dataclass
class Explanation:
    """What will be asked of Spark, and Spark's own plan."""

    tables: list[str]
    access: list[str]  # of each table: what the scan is narrowed by
    index: list[str]
    joins: list[str]
    plan: str


@dataclass
class Partial:
    """A filtered copy of a table, used where a query implies its filter, and
    only while the table is what the copy was made from."""

    table: str
    predicate: Predicate
    path: str
    df: DataFrame
    source: object  # the frame, or the version of the store, that was copied


@dataclass
class Engine:
    spark: SparkSession
    catalog: Catalog = field(default_factory=Catalog)
    security: Security = field(default_factory=Security)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    stores: dict[str, VersionedTable] = field(default_factory=dict)
    partials: list[Partial] = field(default_factory=list)
    stored: dict[str, DataFrame] = field(default_factory=dict)  # Parquet tables before conversion
    warnings: list[str] = field(default_factory=list)

    # --- tables ---

    def add(self, table: TableDef, source: DataFrame | VersionedTable) -> Engine:
        self.catalog.add(table)
        if isinstance(source, VersionedTable):
            self.stores[table.name] = source
        else:
            self.frames[table.name] = source
        return self

    def add_parquet(self, name: str, path: str, primary_key: list[str], **options) -> Engine:
        """A Parquet table; its schema is read when it is first asked for."""

        def read() -> None:
            df = raw(self.spark, path)
            self.stored[name], converted = df, with_epoch_seconds(df)
            self.add(table_of(name, converted, primary_key, **options), converted)

        self.catalog.loaders[name] = read
        return self

    def add_view(self, name: str, table: str, predicate: Predicate) -> Engine:
        self.catalog.add_view(View(name, table, predicate))
        return self

    def _source(self, name: str) -> object:
        self.catalog.table(name)
        return self.stores[name].current if name in self.stores else self.frames[name]

    def materialise(self, table: str, predicate: Predicate | str, path: str) -> Engine:
        """Keep a partial copy; reads whose filter, or whose policy, implies its
        filter scan it instead. A write makes the copy stale: it is then left
        alone until ``refresh``."""
        p = as_predicate(predicate)
        at, source = f"{path.rstrip('/')}/{uuid.uuid4().hex}", self._source(table)
        lower.filtered(self.rows(table), p).write.parquet(at)
        self.partials = [x for x in self.partials if (x.table, x.predicate) != (table, p)]
        self.partials.append(Partial(table, p, path, self.spark.read.parquet(at), source))
        return self

    def refresh(self, table: str) -> Engine:
        """Make stale partial copies of a table anew."""
        for p in [p for p in self.partials if p.table == table and not self._fresh(p)]:
            self.materialise(table, p.predicate, p.path)
        return self

    def _fresh(self, p: Partial) -> bool:
        now = self._source(p.table)
        return p.source == now if p.table in self.stores else p.source is now

    def rows(self, name: str, version: int | None = None) -> DataFrame:
        """All rows, in the table's shape, without regard to who asks."""
        table = self.catalog.table(name)
        df = self.stores[name].read(version) if name in self.stores else self.frames[name]
        if df.columns == [c.name for c in table.live] and all(f.dataType == c.kind.spark() for f, c in zip(df.schema.fields, table.live, strict=True)):
            return df
        if [f.name for f in df.schema.fields] == [c.name for c in table.live] and not any(c.default is not None for c in table.live):
            return df  # narrower integers and the like are read as they are
        return table.read(df)

    # --- reads ---

    def secured(self, ctx: Context, name: str, refs: set[str], deleted: bool = False, filter_: Predicate = TRUE) -> DataFrame:
        table = self.catalog.table(name)
        self.security.authorize(ctx, name, READ)
        self.security.withhold(ctx, table, refs)
        own = self.security.row_filter(ctx, table, READ, deleted)
        sure = And((filter_, own))
        copy = next((p.df for p in self.partials if p.table == name and implies(sure, p.predicate) and self._fresh(p)), None)
        df = self.rows(name) if copy is None else copy
        if copy is None and name in self.stored and self.frames[name] is df:
            bounds = time_bounds(self.stored[name], sure)
            df = df if bounds is None else with_epoch_seconds(self.stored[name].where(bounds))
        df = lower.filtered(df, own)
        readable = self.security.readable(ctx, table)
        return df if readable == df.columns else df.select(*readable)

    def _query(self, ctx: Context, q: Query, views: bool = False) -> DataFrame:
        if q.table in self.catalog.views:
            if not views:
                raise NoSuchColumn(f"{q.table} is a view, and views are read by themselves")
            view = self.catalog.views[q.table]
            q = Query(**{**q.__dict__, "table": view.table}).where(view.predicate)
        table = self.catalog.table(q.table)
        if q.index and q.index not in {i.name for i in table.indexes}:
            raise Refused(f"{q.table} has no index {q.index}")
        df = self.secured(ctx, q.table, _refs(q), q.deleted, q.filter)
        return lower.query(df, q, table.primary_key, lambda inner: self._query(ctx, inner))

    def query(self, q: Query, ctx: Context = ROOT) -> DataFrame:
        return self._query(ctx, q, views=True)

    def get(self, table: str, *key, ctx: Context = ROOT) -> DataFrame:
        """One row by key, or none; a hidden row is none."""
        return self.get_many(table, [key], ctx)

    def get_many(self, table: str, keys: list[tuple], ctx: Context = ROOT) -> DataFrame:
        names = self.catalog.table(table).primary_key
        from .functions.predicates import Compare, In, Or

        if any(len(k) != len(names) for k in keys):
            raise Refused(f"the key of {table} is {', '.join(names)}")
        if len(names) == 1:
            p: Predicate = In(names[0], tuple(k[0] for k in keys))
        else:
            p = Or(tuple(And(tuple(Compare(n, "=", v) for n, v in zip(names, k, strict=True))) for k in keys))
        return self.query(Query(table).where(p), ctx)

    def _narrowed(self, q: Query) -> Query:
        """A query to be grouped: its order, limit and windows don't count."""
        return Query(q.table, q.filter, q.computed, deleted=q.deleted)

    def aggregate(self, q: Query, *aggs: Agg, ctx: Context = ROOT) -> DataFrame:
        return self.grouped(q, Grouping().aggregate(*aggs), ctx)

    def count(self, q: Query, ctx: Context = ROOT) -> int:
        return self.aggregate(q, Agg.count("n"), ctx=ctx).first()["n"]

    def grouped(self, q: Query, g: Grouping, ctx: Context = ROOT) -> DataFrame:
        self.security.withhold(ctx, self.catalog.table(q.table), _group_refs(g))
        bare = self._narrowed(q)
        shifted = lower.shifted_sums(bare, g, lower.scope_of(self.rows(q.table)).bits) if q.table not in self.catalog.views else {}
        for n, (c, _) in shifted.items():
            if n in self.catalog.table(q.table).struct().names or n == c:
                raise Refused(f"there is a column {n} already")
        self.security.withhold(ctx, self.catalog.table(q.table), {c for c, _ in shifted.values()}) if shifted else None
        bare = Query(bare.table, bare.filter, tuple((n, s) for n, s in bare.computed if n not in shifted), deleted=bare.deleted)
        return lower.grouped(self._query(ctx, bare), g, shifted=shifted)

    def _chain(self, c: Chain, ctx: Context) -> lower.Joined:
        j = lower.chain(c, lambda q: self._query(ctx, q), lambda n: self.catalog.table(n).primary_key)
        self.warnings += j.warn(set().union(*(s.residual.refs() for s in c.steps), *(s.refs() for _, s in c.computed)))
        return j

    def chain(self, c: Chain, ctx: Context = ROOT) -> DataFrame:
        return lower.cut(self._chain(c, ctx), c)

    join = chain

    def grouped_chain(self, c: Chain, g: Grouping, ctx: Context = ROOT) -> DataFrame:
        """Groups over the joined rows; limits of the join don't count."""
        if any(q.computed for q in (c.first, *(s.query for s in c.steps))):
            raise Refused("a grouped join computes over the joined row, not in one table's query")
        bare = Chain(self._narrowed(c.first), c.alias, tuple(type(s)(self._narrowed(s.query), s.on, s.how, s.alias, s.residual, s.algorithm) for s in c.steps), c.computed)
        j = self._chain(bare, ctx)
        self.warnings += j.warn(_group_refs(g))
        return lower.grouped(j.df, g, j.scope)

    grouped_join = grouped_chain

    # --- introspection ---

    def _explained(self, ctx: Context, queries: list[Query], df: DataFrame, joins: list[str]) -> Explanation:
        access, index = [], []
        for q in queries:
            self.security.authorize(ctx, q.table, EXPLAIN)
            table = self.catalog.table(q.table)
            bound = {n for p in conjuncts(q.filter) for n in p.refs() if not isinstance(p, InQuery)}
            lead = table.primary_key[0]
            access.append(f"{q.table}: " + (f"bounds on {lead}" if lead in bound else "filtered scan" if bound else "scan"))
            index.append(q.index or "")
        return Explanation([q.table for q in queries], access, index, joins, df._jdf.queryExecution().toString())

    def explain(self, q: Query, g: Grouping | None = None, ctx: Context = ROOT) -> Explanation:
        return self._explained(ctx, [q], self.query(q, ctx) if g is None else self.grouped(q, g, ctx), [])

    def explain_chain(self, c: Chain, g: Grouping | None = None, ctx: Context = ROOT) -> Explanation:
        df = self.chain(c, ctx) if g is None else self.grouped_chain(c, g, ctx)
        return self._explained(ctx, [c.first, *(s.query for s in c.steps)], df, [f"{s.how} on {', '.join(f'{a} = {b}' for a, b in s.on)}" for s in c.steps])

    explain_join = explain_chain

    def step_counts(self, c: Chain, ctx: Context = ROOT) -> list[int]:
        """Rows after each step of a chain: a count for each, to find out."""
        return [self._chain(Chain(c.first, c.alias, c.steps[: i + 1]), ctx).df.count() for i in range(len(c.steps))]

    def analyze(self, table: str, columns: list[str] | None = None, ctx: Context = ROOT) -> statistics.TableStatistics:
        return statistics.analyze(self.secured(ctx, table, set(columns or ())), columns)

    # --- SQL and writes ---

    def sql(self, text: str, ctx: Context = ROOT) -> DataFrame:
        from .sql import run

        return run(self, text, ctx)

    def writer(self, ctx: Context = ROOT, clock=None):
        from .operators.writes import Writer

        return Writer(self, ctx, clock)


def _refs(q: Query) -> set[str]:
    out = set(q.filter.refs())
    own = {n for n, _ in q.computed} | {w.name for w in q.windows}
    for _, s in q.computed:
        out |= s.refs()
    for w in q.windows:
        out |= {*w.partition, *(o.name for o in w.order), *([w.column] if w.column else [])}
    out |= {o.name for o in q.order}
    if q.projection != "*":
        out |= set(q.projection)
    return out - own


def _group_refs(g: Grouping) -> set[str]:
    return {*g.keys, *(a.column for a in g.aggregates if a.column)}


