"""Writes: each is checked as a whole against the current version, and then
published as the next one. A write that fails leaves nothing behind."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CheckFailed, DuplicateKey, Forbidden, ForeignKeyFailed, Refused, RowNotFound, WriteError
from ..functions.language import as_predicate
from ..functions.predicates import TRUE, Predicate, conjuncts
from ..functions.scalars import Scalar
from ..plans.lower import filtered, scope_of
from ..schema import CREATED, UPDATED, ForeignKey, TableDef
from ..security import DELETE, INSERT, READ, UPDATE
from ..sources.tables import memory
from ..sources.versioned import publish

#: Rows that a cascade may delete.
MOST_CASCADED = 10_000
#: Operations of one batch.
MOST_BATCHED = 1_000


def _same(a: DataFrame, b: DataFrame, left: list[str], right: list[str]):
    out = F.lit(True)
    for x, y in zip(left, right, strict=True):
        out = out & (a[f"`{x}`"] == b[f"`{y}`"])
    return out


class Writer:
    def __init__(self, engine, ctx, clock=None):
        self.engine, self.ctx, self.clock = engine, ctx, clock or (lambda: int(time.time()))
        self.staged: dict[str, DataFrame] | None = None
        self.added: dict[str, DataFrame | None] = {}  # of a batch: rows added to a table, None if it is rewritten
        self._expected: dict[str, int] = {}

    # --- the current rows, and the next version ---

    def _table(self, name: str) -> TableDef:
        if name in self.engine.catalog.views:
            raise Refused(f"{name} is a view; it is not written through")
        return self.engine.catalog.table(name)

    def _now(self, name: str) -> DataFrame:
        if self.staged is not None and name in self.staged:
            return self.staged[name]
        if name in self.engine.stores:
            self._expected.setdefault(name, self.engine.stores[name].current)
            return self.engine.rows(name, self._expected[name])
        return self.engine.rows(name)

    def _publish(self, name: str, df: DataFrame, added: DataFrame | None = None) -> int:
        """``df``: all rows from now on; ``added``: those that are new, where
        the others stay as they are, so that a store need write no more."""
        if self.staged is not None:
            before = self.added.get(name) if name in self.staged else None
            both = added if name not in self.staged else None if added is None or before is None else before.unionByName(added)
            self.staged[name], self.added[name] = df, both
            return 0
        if name in self.engine.stores:
            store, expected = self.engine.stores[name], self._expected.pop(name, None)
            return store.write(df, expected) if added is None else store.append(added, expected)
        self.engine.frames[name] = df
        return 0

    def _visible(self, table: TableDef, action: str) -> DataFrame:
        return filtered(self._now(table.name), self.engine.security.row_filter(self.ctx, table, action))

    def _rows(self, table: TableDef, rows) -> DataFrame:
        df = rows if isinstance(rows, DataFrame) else memory(self.engine.spark, table, rows)
        return table.read(df)

    def _stamp(self, table: TableDef, df: DataFrame, new: bool) -> DataFrame:
        """The store's clock overwrites what the caller says."""
        now = {c.name: F.lit(self.clock()).cast("bigint") for c in table.live if c.managed == UPDATED or (c.managed == CREATED and new)}
        return df.withColumns(now) if now else df

    # --- checks ---

    def _check_rows(self, table: TableDef, df: DataFrame, action: str, others: DataFrame) -> None:
        """``others``: the rows that stay as they are beside ``df``."""
        key, scope = list(table.primary_key), scope_of(df)
        must = self.engine.security.row_filter(self.ctx, table, action)
        # one pass for all that is asked of single rows: how many fail each
        asked: list[tuple[Exception, Any]] = [(CheckFailed(f"{table.name}.{c.name} is required"), F.col(f"`{c.name}`").isNull()) for c in table.live if not c.nullable]
        if must != TRUE:
            asked.append((Forbidden(f"a row that the caller may not {action} in {table.name}"), ~F.coalesce(must.column(scope), F.lit(False))))
        for check in table.checks:  # Unknown passes
            asked.append((CheckFailed(f"{table.name}: check {check.name}"), ~as_predicate(check.predicate).column(scope)))
        failed = df.agg(*[F.coalesce(F.bool_or(F.coalesce(bad, F.lit(False))), F.lit(False)).alias(f"f{i}") for i, (_, bad) in enumerate(asked)]).first() if asked else ()
        for (error, _), bad in zip(asked, failed, strict=True):
            if bad:
                raise error
        if not df.groupBy(*key).count().where("count > 1").isEmpty():
            raise DuplicateKey(f"{table.name}: a key twice in one write")
        for i in table.indexes:
            if i.unique:
                self._check_unique(table, df, others, i)
        for f in table.foreign_keys:
            self._check_parent(table, df, f)

    def _check_unique(self, table: TableDef, df: DataFrame, others: DataFrame, index) -> None:
        cols, both = list(index.columns), df.unionByName(others)
        if index.only_where is not None:
            both = filtered(both, as_predicate(index.only_where))
        for c in cols:  # nulls do not collide
            both = both.where(F.col(f"`{c}`").isNotNull())
        if not both.groupBy(*cols).count().where("count > 1").isEmpty():
            raise DuplicateKey(f"{table.name}: index {index.name} is unique")

    def _check_parent(self, table: TableDef, df: DataFrame, f: ForeignKey) -> None:
        parent = self._table(f.parent)
        seen = self._visible(parent, READ)
        if f.parent == table.name:
            seen = seen.unionByName(df)
        for c in f.columns:
            df = df.where(F.col(f"`{c}`").isNotNull())
        df, seen = df.alias("c"), seen.select(*[F.col(f"`{k}`").alias(f"_{k}") for k in parent.primary_key])
        if not df.join(seen, _same(df, seen, list(f.columns), [f"_{k}" for k in parent.primary_key]), "left_anti").isEmpty():
            raise ForeignKeyFailed(f"{table.name} refers to no row of {f.parent}")

    def _may_write_whole_rows(self, table: TableDef) -> None:
        if len(self.engine.security.readable(self.ctx, table)) < len(table.live) and not self.ctx.superuser:
            raise Forbidden(f"the caller sees some columns of {table.name} only and writes no whole rows")

    # --- whole rows ---

    def insert(self, name: str, rows) -> int:
        table = self._table(name)
        self.engine.security.authorize(self.ctx, name, INSERT)
        df = self._stamp(table, self._rows(table, rows), True)
        if table.soft_delete and not df.where(F.col(table.soft_delete).isNotNull()).isEmpty():
            raise CheckFailed(f"{name}: rows are not inserted as deleted")
        now = self._now(name)
        self._check_rows(table, df, INSERT, now)
        if not df.join(now, list(table.primary_key), "left_semi").isEmpty():  # hidden rows collide too
            raise DuplicateKey(f"{name}: a row of this key is there")
        return self._publish(name, now.unionByName(df), df)

    def _replace(self, table: TableDef, df: DataFrame, action: str) -> int:
        now, key = self._now(table.name), list(table.primary_key)
        created = [c.name for c in table.live if c.managed == CREATED]
        if created:
            df = df.drop(*created).join(now.select(*key, *created), key, "left").select(*[c.name for c in table.live])
            df = df.withColumns({c: F.coalesce(c, F.lit(self.clock()).cast("bigint")) for c in created})
        rest = now.join(df, key, "left_anti")
        self._check_rows(table, df, action, rest)
        return self._publish(table.name, rest.unionByName(df))

    def update(self, name: str, rows) -> int:
        table = self._table(name)
        self.engine.security.authorize(self.ctx, name, UPDATE)
        self._may_write_whole_rows(table)
        df = self._stamp(table, self._rows(table, rows), False)
        if not df.join(self._visible(table, UPDATE), list(table.primary_key), "left_anti").isEmpty():
            raise RowNotFound(f"{name}: no row of this key")
        return self._replace(table, df, UPDATE)

    def upsert(self, name: str, rows) -> int:
        table = self._table(name)
        for action in (INSERT, UPDATE):
            self.engine.security.authorize(self.ctx, name, action)
        self._may_write_whole_rows(table)
        df, key = self._stamp(table, self._rows(table, rows), False), list(table.primary_key)
        there = df.join(self._now(name), key, "left_semi")
        if not there.join(self._visible(table, UPDATE), key, "left_anti").isEmpty():
            raise RowNotFound(f"{name}: no row of this key")
        return self._replace(table, df, UPDATE)

    def _unchanged(self, table: TableDef, old, action: str) -> None:
        was, now = self._rows(table, old), self._visible(table, action)
        same = F.lit(True)
        for c in table.live:
            same = same & was[f"`{c.name}`"].eqNullSafe(now[f"`{c.name}`"])
        if not was.join(now, same, "left_anti").isEmpty():
            raise RowNotFound(f"{table.name}: the row has changed or is gone")

    def update_if_unchanged(self, name: str, old, new) -> int:
        self._unchanged(self._table(name), old, UPDATE)
        return self.update(name, new)

    def delete_if_unchanged(self, name: str, old) -> int:
        table = self._table(name)
        self._unchanged(table, old, DELETE)
        return self.delete(name, self._rows(table, old).select(*table.primary_key))

    # --- deletes ---

    def delete(self, name: str, keys) -> int:
        """Rows by key, with what cascades. ``keys``: a DataFrame of keys, or
        tuples."""
        table = self._table(name)
        self.engine.security.authorize(self.ctx, name, DELETE)
        if not isinstance(keys, DataFrame):
            schema = table.struct()
            keys = self.engine.spark.createDataFrame([tuple(k) if isinstance(k, (list, tuple)) else (k,) for k in keys], type(schema)([schema[k] for k in table.primary_key]))
        if not keys.join(self._visible(table, DELETE), list(table.primary_key), "left_anti").isEmpty():
            raise RowNotFound(f"{name}: no row of this key")
        return self._delete(table, keys)

    def _delete(self, table: TableDef, keys: DataFrame) -> int:
        doomed = self._closure(table, keys)
        for t, k in doomed.items():
            self._restrict(t, k, doomed)
        for t, k in doomed.items():
            definition, now = self._table(t), self._now(t)
            key = list(definition.primary_key)
            if definition.soft_delete:
                gone = now.join(k, key, "left_semi").withColumn(definition.soft_delete, F.lit(self.clock()).cast("bigint"))
                self._publish(t, now.join(k, key, "left_anti").unionByName(gone))
            else:
                self._publish(t, now.join(k, key, "left_anti"))
        return sum(k.count() for k in doomed.values()) if self.staged is None else 0

    def _closure(self, table: TableDef, keys: DataFrame) -> dict[str, DataFrame]:
        """Keys to delete by table: cascades are followed to the end, among
        rows that are not deleted already, whoever may see them."""
        doomed, queue, total = {table.name: keys.distinct()}, [(table, keys)], 0
        while queue:
            parent, lost = queue.pop()
            for child, f in self.engine.catalog.children(parent.name):
                if f.on_delete != "cascade":
                    continue
                self.engine.security.authorize(self.ctx, child.name, DELETE)
                rows = self._now(child.name)
                if child.soft_delete:
                    rows = rows.where(F.col(child.soft_delete).isNull())
                hit = self._referring(rows, f, parent, lost).select(*child.primary_key).distinct()
                if child.name in doomed:
                    hit = hit.join(doomed[child.name], list(child.primary_key), "left_anti")
                n = hit.limit(MOST_CASCADED + 1).count()
                if not n:
                    continue
                total += n
                if total > MOST_CASCADED:
                    raise WriteError(f"the delete would cascade to more than {MOST_CASCADED} rows")
                # bounded by MOST_CASCADED, so that its lineage can end here
                hit = self.engine.spark.createDataFrame(hit.collect(), hit.schema)
                doomed[child.name] = doomed[child.name].union(hit) if child.name in doomed else hit
                queue.append((child, hit))
        return doomed

    @staticmethod
    def _referring(rows: DataFrame, f: ForeignKey, parent: TableDef, keys: DataFrame) -> DataFrame:
        named = keys.select(*[F.col(f"`{k}`").alias(f"_{k}") for k in parent.primary_key])
        return rows.join(named, _same(rows, named, list(f.columns), [f"_{k}" for k in parent.primary_key]), "left_semi")

    def _restrict(self, name: str, keys: DataFrame, doomed: dict[str, DataFrame]) -> None:
        parent = self._table(name)
        for child, f in self.engine.catalog.children(name):
            left = self._referring(self._now(child.name), f, parent, keys)  # deleted rows refer too
            if child.name in doomed:
                left = left.join(doomed[child.name], list(child.primary_key), "left_anti")
            if f.on_delete != "cascade" and not left.isEmpty():
                raise ForeignKeyFailed(f"rows of {child.name} refer to {name}")

    def _matched(self, table: TableDef, p: Predicate, action: str, at_most: int | None) -> DataFrame:
        self.engine.security.authorize(self.ctx, table.name, action)
        self.engine.security.withhold(self.ctx, table, p.refs())
        hit = filtered(self._visible(table, action), p)
        if at_most is not None and hit.limit(at_most + 1).count() > at_most:
            raise WriteError(f"{table.name}: more than {at_most} rows match")
        return hit

    def delete_where(self, name: str, p: Predicate, at_most: int | None = None) -> DataFrame:
        """Delete the rows that match, and return them as they were."""
        table = self._table(name)
        hit = self._matched(table, p, DELETE, at_most)
        self._delete(table, hit.select(*table.primary_key))
        return hit

    def update_where(self, name: str, p: Predicate, assign: list[tuple[str, Scalar]], at_most: int | None = None) -> int:
        """Set columns of the rows that match; all see the old values."""
        table, names = self._table(name), [n for n, _ in assign]
        if len(set(names)) < len(names):
            raise Refused(f"{name}: a column is set twice")
        if set(names) & set(table.primary_key):
            raise Refused(f"{name}: the key is not set")
        hit = self._matched(table, p, UPDATE, at_most)
        self.engine.security.withhold(self.ctx, table, set(names).union(*(s.refs() for _, s in assign)))
        scope = scope_of(hit)
        for n, s in assign:
            kind = s.kind(scope)
            if kind and not kind.matches(table.column(n).kind):
                raise Refused(f"{name}.{n} is no {kind.type.value}")
        new = hit.withColumns({n: s.column(scope).cast(table.column(n).kind.spark()) for n, s in assign})
        return self._replace(table, self._stamp(table, new, False), UPDATE)

    def purge_deleted(self, name: str, before: int) -> int:
        """Remove for good what was deleted strictly before a time."""
        table = self._table(name)
        if not table.soft_delete:
            raise Refused(f"{name} does not keep deleted rows")
        self.engine.security.authorize(self.ctx, name, DELETE)
        own = [q for q in conjuncts(self.engine.security.row_filter(self.ctx, table, DELETE)) if table.soft_delete not in q.refs()]
        now, scope = self._now(name), scope_of(self._now(name))
        gone = F.col(table.soft_delete) < before
        for q in own:
            gone = gone & q.column(scope)
        return self._publish(name, now.where(~F.coalesce(gone, F.lit(False))))

    # --- several at once ---

    def batch(self, operations: list[tuple[str, tuple]], all_or_nothing: bool = True) -> list[Any]:
        """Operations as (method, arguments), in order, each seeing those
        before it. All or nothing: published at the end, once a table;
        otherwise each by itself, a failure being its result."""
        if len(operations) > MOST_BATCHED:
            raise Refused(f"a batch has {MOST_BATCHED} operations at the most")
        out: list[Any] = []
        if all_or_nothing:
            self.staged, self.added = {}, {}
            try:
                out = [getattr(self, m)(*args) for m, args in operations]
                done, added = self.staged, self.added
            finally:
                self.staged = None
            stored = [n for n in done if n in self.engine.stores]
            if stored:
                change = lambda n, store, before: (store, done[n], before, False) if added[n] is None or not store.room(before) else (store, added[n], before, True)
                publish([change(n, self.engine.stores[n], self._expected.pop(n)) for n in stored])
            for name in done.keys() - set(stored):
                self._publish(name, done[name])
            return out
        for m, args in operations:
            try:
                out.append(getattr(self, m)(*args))
            except (WriteError, Refused) as e:
                out.append(e)
        return out
