"""An extension: the same specifications over unbounded tables.

Queries themselves are of bounded tables; here filters, computed values and
groups by time bucket run as Structured Streaming, with a watermark that bounds
the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.predicates import TRUE
from ..operators.aggregates import aggregate
from ..plans import lower
from ..plans.spec import Grouping, Query


def stream(df: DataFrame, q: Query) -> DataFrame:
    """Filters, computes and projection of a stream; what needs all rows
    (order, limits, windows, pages) is refused."""
    if q.order or q.most is not None or q.skip or q.windows or q.paged:
        raise Refused("a stream has no order, limit, window or page")
    return lower.query(df, q, ())


def tumbling(df: DataFrame, time: str, seconds: int, late: str, g: Grouping) -> DataFrame:
    """Groups by buckets of a timestamp column and the grouping's keys; a
    bucket is final once the watermark, ``late`` behind, has passed it."""
    if g.order or g.most is not None or g.skip or any(a.function == "count_distinct" for a in g.aggregates):
        raise Refused("a stream's groups have no order, limit or exact distinct count")
    marked = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    scope = lower.scope_of(df.drop(time))
    bucket = F.window(time, f"{seconds} seconds")
    out = marked.groupBy(bucket.alias("_w"), *[scope.column(k).alias(k) for k in g.keys]).agg(*[aggregate(a, scope).alias(a.name) for a in g.aggregates])
    out = out.select(F.unix_seconds(F.col("_w.start").cast("timestamp")).alias("bucket"), *g.keys, *[a.name for a in g.aggregates])
    return out if g.having_ == TRUE else out.where(g.having_.column(lower.scope_of(out)))
