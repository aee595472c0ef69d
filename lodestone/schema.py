"""Table definitions, validated when they are made, and the catalog."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import NoSuchColumn, SchemaError
from .types import I64, Kind, ValueType

CREATED, UPDATED = "created_at", "updated_at"


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: Kind
    nullable: bool = False
    default: Any = None
    added_in: int = 1
    dropped_in: int | None = None
    previous_names: tuple[str, ...] = ()
    managed: str | None = None  # CREATED or UPDATED: stamped by the store


@dataclass(frozen=True)
class IndexDef:
    """A secondary index. Answers never depend on it: it is advice for the
    layout of a table, except ``unique``, which writes enforce."""

    name: str
    columns: tuple[str, ...] = ()
    unique: bool = False
    text: bool = False
    expression: Any = None  # a Scalar
    only_where: Any = None  # a Predicate


@dataclass(frozen=True)
class Check:
    name: str
    predicate: Any  # a Predicate; only False fails


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    on_delete: str = "restrict"  # or "cascade"


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...]
    indexes: tuple[IndexDef, ...] = ()
    checks: tuple[Check, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    tenant: str | None = None
    soft_delete: str | None = None
    version: int = 1

    def __post_init__(self):
        refuse = lambda why: (_ for _ in ()).throw(SchemaError(f"table {self.name}: {why}"))
        names = [c.name for c in self.columns]
        for n in names:
            if names.count(n) > 1:
                refuse(f"duplicate column {n}")
        by = {c.name: c for c in self.columns}
        for c in self.columns:
            if c.kind.type is ValueType.ARRAY and c.kind.element is None:
                refuse(f"array column {c.name} names no element type")
            if c.kind.type is ValueType.ARRAY and c.kind.element in (ValueType.ARRAY, ValueType.VECTOR):
                refuse(f"array column {c.name} is nested")
            if c.kind.type is ValueType.DECIMAL and c.kind.scale > 18:
                refuse(f"the scale of {c.name} is too large")
            if c.managed and (c.kind != I64 or c.nullable or c.name in self.primary_key):
                refuse(f"managed column {c.name} must be an i64, not nullable and not in the key")
        if not self.primary_key:
            refuse("it has no primary key")
        for k in self.primary_key:
            if k not in by:
                refuse(f"the key names no column {k}")
            if by[k].nullable:
                refuse(f"key column {k} is nullable")
            if by[k].kind.type in (ValueType.VECTOR, ValueType.ARRAY):
                refuse(f"key column {k} is a {by[k].kind.type.value}")
        if self.tenant and self.primary_key[0] != self.tenant:
            refuse("the tenant column is not the first of the key")
        if self.soft_delete:
            c = by.get(self.soft_delete) or refuse(f"no column {self.soft_delete} to mark deleted rows")
            if c.kind != I64 or not c.nullable or c.name in self.primary_key:
                refuse(f"soft-delete column {c.name} must be a nullable i64 outside the key")
        seen = set()
        for i in self.indexes:
            if i.name in seen:
                refuse(f"duplicate index {i.name}")
            seen.add(i.name)
            for c in i.columns:
                if c not in by:
                    refuse(f"index {i.name} names no column {c}")
                if i.text and by[c].kind.type is not ValueType.STR:
                    refuse(f"text index {i.name} is on {c}, which is no string")
                if by[c].kind.type in (ValueType.VECTOR, ValueType.ARRAY):
                    refuse(f"index {i.name} is on {c}, a {by[c].kind.type.value}")
        if len({c.name for c in self.checks}) < len(self.checks):
            refuse("duplicate check")
        for f in self.foreign_keys:
            if not f.columns:
                refuse("a foreign key names no columns")

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if name == c.name or name in c.previous_names:
                return c
        raise NoSuchColumn(f"table {self.name} has no column {name}")

    @property
    def live(self) -> list[ColumnDef]:
        return [c for c in self.columns if c.dropped_in is None or c.dropped_in > self.version]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.kind.spark(), c.nullable) for c in self.live])

    def read(self, df: DataFrame) -> DataFrame:
        """``df`` in this definition's shape: renamed columns found by their
        old names, columns that old rows lack at their defaults."""
        out = []
        for c in self.live:
            found = next((n for n in (c.name, *c.previous_names) if n in df.columns), None)
            value = F.lit(c.default) if found is None else F.col(f"`{found}`")
            if found is not None and c.default is not None:
                value = F.coalesce(value, F.lit(c.default))
            out.append(value.cast(c.kind.spark()).alias(c.name))
        return df.select(*out)


@dataclass
class View:
    """A named predicate over one base table; read by single-table queries."""

    name: str
    table: str
    predicate: Any


@dataclass
class Catalog:
    tables: dict[str, TableDef] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    loaders: dict[str, Any] = field(default_factory=dict)  # tables that are looked at when they are first asked for

    def add(self, table: TableDef) -> TableDef:
        if table.name in self.tables or table.name in self.views:
            raise SchemaError(f"there is a table {table.name}")
        for f in table.foreign_keys:
            if f.parent != table.name and f.parent not in self.tables:
                raise SchemaError(f"table {table.name}: foreign key to {f.parent}, which is no table")
            parent = table if f.parent == table.name else self.tables[f.parent]
            if [table.column(c).kind for c in f.columns] != [parent.column(c).kind for c in parent.primary_key]:
                raise SchemaError(f"table {table.name}: its foreign key does not match the key of {f.parent}")
        self.tables[table.name] = table
        return table

    def add_view(self, view: View) -> View:
        if view.name in self.tables or view.name in self.views:
            raise SchemaError(f"view {view.name}: its name is taken")
        self.table(view.table)
        self.views[view.name] = view
        return view

    def table(self, name: str) -> TableDef:
        if name not in self.tables and name in self.loaders:
            self.loaders.pop(name)()
        if name not in self.tables:
            raise NoSuchColumn(f"there is no table {name}")
        return self.tables[name]

    def children(self, parent: str) -> list[tuple[TableDef, ForeignKey]]:
        return [(t, f) for t in self.tables.values() for f in t.foreign_keys if f.parent == parent]


def table_of(name: str, df: DataFrame, primary_key: list[str], **options) -> TableDef:
    """A definition read off a DataFrame's schema."""
    from .types import kind_of

    columns = tuple(ColumnDef(f.name, kind_of(f.dataType), f.nullable and f.name not in primary_key) for f in df.schema.fields)
    return TableDef(name, columns, tuple(primary_key), **options)


def widened(old: TableDef, new: TableDef) -> list[str]:
    """Migration steps from one version to the next, or a refusal: columns may
    be added (nullable or with a default), renamed, dropped; keys may not
    change; indexes come and go."""
    if new.version <= old.version or new.name != old.name:
        raise SchemaError(f"table {new.name}: a migration needs a higher version of the same table")
    if new.primary_key != old.primary_key:
        raise SchemaError(f"table {new.name}: the key cannot change")
    steps, found = [], set()
    for c in new.columns:
        before = next((o for o in old.columns if o.name in (c.name, *c.previous_names)), None)
        if before is None:
            if not c.nullable and c.default is None and not c.managed:
                raise SchemaError(f"table {new.name}: new column {c.name} needs a default or to be nullable")
            steps.append(f"add column {c.name}")
            continue
        found.add(before.name)
        if before.kind != c.kind:
            raise SchemaError(f"table {new.name}: the type of {c.name} cannot change")
        if before.nullable and not c.nullable and c.default is None:
            raise SchemaError(f"table {new.name}: {c.name} cannot become required without a default")
        if before.name != c.name:
            steps.append(f"rename column {before.name} to {c.name}")
    for o in old.columns:
        if o.name not in found:
            raise SchemaError(f"table {new.name}: column {o.name} is gone; mark it dropped instead")
    olds, news = {i.name: i for i in old.indexes}, {i.name: i for i in new.indexes}
    steps += [f"drop index {n}" for n in olds if n not in news or olds[n] != news[n]]
    steps += [f"build index {n}" for n in news if n not in olds or olds[n] != news[n]]
    return [*steps, f"record version {new.version}"]


