"""Column profiles: exact counts, nulls, histograms."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_statistics
from ..plans.lower import scope_of

BUCKETS = 64


@dataclass
class ColumnStatistics:
    distinct: int
    nulls: int
    low: Any
    high: Any
    histogram: list  # bounds of buckets that hold about as many rows each


@dataclass
class TableStatistics:
    rows: int
    columns: dict[str, ColumnStatistics]


def analyze(df: DataFrame, columns: list[str] | None = None) -> TableStatistics:
    """One pass for counts, bounds and quantiles, one for distinct values
    (approximate from 10,000 on, by HyperLogLog at 1 %)."""
    scope = scope_of(df)
    names = [c for c in columns or df.columns if scope.kind(c).type.value not in ("vector", "array")]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        c = scope.column(n)
        aggs += [F.count(c).alias(f"k{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.approx_count_distinct(c, 0.01).alias(f"d{i}")]
        if scope.kind(n).numeric:
            aggs.append(F.percentile_approx(c, [j / BUCKETS for j in range(1, BUCKETS)], 10_000).alias(f"h{i}"))
    r = df.agg(*aggs).first().asDict()
    few = [i for i in range(len(names)) if r[f"d{i}"] <= 10_000]
    exact = df.agg(*[F.count_distinct(scope.column(names[i])).alias(f"d{i}") for i in few]).first().asDict() if few else {}
    out = {n: ColumnStatistics(exact.get(f"d{i}", r[f"d{i}"]), r["rows"] - r[f"k{i}"], r[f"lo{i}"], r[f"hi{i}"], r.get(f"h{i}") or []) for i, n in enumerate(names)}
    return TableStatistics(r["rows"], out)


__all__ = ["ColumnStatistics", "TableStatistics", "analyze", "term_statistics"]
