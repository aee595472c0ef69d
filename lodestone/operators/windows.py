"""Window functions of one table, sharing partitions where specs agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.predicates import Scope
from ..plans.spec import Agg, Window
from .aggregates import FUNCTIONS, aggregate
from .ordering import order_columns

RANKINGS = ("row_number", "rank", "dense_rank")


def window(w: Window, scope: Scope, key: list[str]) -> Column:
    """``key`` breaks ties, for row numbers and neighbours."""
    if w.function in (*RANKINGS, "lag", "lead") and not w.order:
        raise Refused(f"{w.function} needs an ORDER BY")
    base = W.partitionBy(*[scope.column(p) for p in w.partition])
    order = order_columns(w.order, scope)
    if w.function in ("row_number", "lag", "lead"):
        named = {o.name for o in w.order}
        order += [scope.column(k).asc() for k in key if k not in named]
    spec = base.orderBy(*order) if order else base
    if w.function in RANKINGS:
        return getattr(F, w.function)().over(spec).cast("bigint")
    if w.function in ("lag", "lead"):
        if w.by < 1:
            raise Refused(f"{w.function} looks at least one row away")
        return getattr(F, w.function)(scope.column(w.column), w.by).over(spec)
    if w.function not in FUNCTIONS:
        raise Refused(f"no window function {w.function}")
    if w.function == "count_distinct":
        if w.order:
            raise Refused("a running COUNT(DISTINCT) is not offered")
        return F.size(F.collect_set(scope.column(w.column)).over(spec)).cast("bigint")
    agg = Agg(w.name, w.function, w.column)
    if w.function == "sum" and scope.kind(w.column).integer:
        return F.sum(scope.column(w.column).cast("decimal(28,0)")).over(spec).try_cast("bigint")
    if w.function == "sum" and scope.kind(w.column).scale:
        kind = scope.kind(w.column)
        return F.sum(scope.column(w.column).cast(f"decimal(28,{kind.scale})")).over(spec).try_cast(f"decimal(18,{kind.scale})")
    return aggregate(agg, scope).over(spec)
