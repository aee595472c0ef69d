"""Readers: Parquet, rows in memory, TOML seeds, generated rows."""

from __future__ import annotations

import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions.predicates import Compare, In, Predicate, conjuncts
from ..schema import TableDef
from ..types import adapt


def with_epoch_seconds(df: DataFrame) -> DataFrame:
    """Timestamps as whole seconds since the epoch, floored, in UTC; dates as
    their midnight. What the value model knows stays as it is."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            c = F.unix_seconds(c.cast("timestamp"))
        out.append(c.alias(f.name))
    return df.select(*out)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table in the value model. Filters and columns are pushed down
    to the scan; timestamps are converted as they are read."""
    return with_epoch_seconds(raw(spark, path))


def raw(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as it is stored. Timestamps without a zone are read as
    those of UTC: so they are instants, whatever the session's zone, and bounds
    on them reach the scan."""
    seen = spark.read.parquet(path).schema
    zoned = T.StructType([T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in seen.fields])
    return spark.read.schema(zoned).parquet(path)


#: Seconds that Spark's timestamp literals hold without doubt: years 1 to 9999.
_FIRST_SECOND, _LAST_SECOND = -62135596800, 253402300799


def time_bounds(df: DataFrame, p: Predicate) -> Column | None:
    """What a filter in epoch seconds says of the stored timestamps and dates,
    so that scans can skip by it: no row that the filter admits is left out.
    Seconds are floored, so ``<= v`` is ``< v + 1`` of the instant."""
    kinds = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.DateType))}
    out: Column | None = None

    def add(name: str, op: str, seconds: int) -> None:
        nonlocal out
        if not _FIRST_SECOND <= seconds <= _LAST_SECOND:
            return
        c = F.col(f"`{name}`")
        if isinstance(kinds[name], T.DateType):  # a date is its midnight
            day = F.date_add(F.lit("1970-01-01").cast("date"), seconds // 86400)
            bound = c >= day if op == ">=" else c <= day
        else:
            at = F.timestamp_seconds(F.lit(seconds))
            bound = c >= at if op == ">=" else c < at
        out = bound if out is None else out & bound

    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    for q in conjuncts(p):
        if isinstance(q, Compare) and q.name in kinds and whole(q.value):
            if q.op in ("=", ">=", ">"):
                add(q.name, ">=", q.value + (q.op == ">"))
            if q.op in ("=", "<=", "<"):
                add(q.name, "<", q.value + (q.op != "<"))
        elif isinstance(q, In) and q.name in kinds and q.values and all(map(whole, q.values)):
            add(q.name, ">=", min(q.values))
            add(q.name, "<", max(q.values) + 1)
    return out


def hits_defaults(df: DataFrame) -> DataFrame:
    """Wide log tables as they are usually loaded: bytes are text, a null
    number is 0 and a null text empty."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.BinaryType, T.StringType)):
            c = F.coalesce(c.cast("string"), F.lit(""))
        elif isinstance(f.dataType, T.IntegralType):
            c = F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
        out.append(c.alias(f.name))
    return df.select(*out)


def memory(spark: SparkSession, table: TableDef, rows: list[dict[str, Any]]) -> DataFrame:
    """Rows in memory, checked against the definition."""
    out = []
    for r in rows:
        extra = set(r) - {c.name for c in table.live}
        if extra:
            raise SchemaError(f"table {table.name} has no column {', '.join(sorted(extra))}")
        row = []
        for c in table.live:
            v = adapt(r.get(c.name, c.default), c.kind)
            if v is None and not c.nullable and not c.managed:
                raise SchemaError(f"table {table.name}: {c.name} is required")
            row.append(v)
        out.append(tuple(row))
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.struct().fields])
    return spark.createDataFrame(out, loose)


def seed_toml(spark: SparkSession, catalog, text: str) -> dict[str, DataFrame]:
    """Tables from TOML: arrays of tables, one a row, by table name."""
    return {name: memory(spark, catalog.table(name), rows) for name, rows in tomllib.loads(text).items()}


def factory(spark: SparkSession, n: int, columns: dict[str, Column]) -> DataFrame:
    """``n`` generated rows; columns are expressions in ``id``, so that the
    same rows come each time on any number of machines."""
    return spark.range(n).select(*[c.alias(k) for k, c in columns.items()])


def cycle(values: list) -> Column:
    """One value after the other, by id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("id"), F.lit(len(values))) + 1).cast("int"))


def seeded(seed: int, below: int) -> Column:
    """A number below ``below`` that looks random, from the id and a seed."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(below))


def null_for(c: Column, every: int) -> Column:
    return F.when(F.pmod(F.col("id"), F.lit(every)) != 0, c)
