"""The seven aggregates, as partial and final JVM-side aggregations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NotSummable, Refused
from ..functions.predicates import Scope
from ..plans.spec import Agg
from ..types import F64, I64, ValueType

FUNCTIONS = ("count", "count_column", "min", "max", "sum", "avg", "count_distinct")


def aggregate(agg: Agg, scope: Scope) -> Column:
    """Sums of integers are exact and null beyond 64 bits; averages are always
    doubles, and those of a decimal count its units."""
    if agg.function not in FUNCTIONS:
        raise Refused(f"no aggregate {agg.function}; there are {', '.join(FUNCTIONS)}")
    if agg.function == "count":
        return F.count(F.lit(1))
    kind, c = scope.kind(agg.column), scope.column(agg.column)
    if agg.function in ("sum", "avg") and not kind.numeric:
        raise NotSummable(f"{agg.column} is a {kind.type.value}; only numbers are summed")
    if agg.function == "count_column":
        return F.count(c)
    if agg.function == "count_distinct":
        return F.count_distinct(c)
    if agg.function in ("min", "max"):
        return F.min(c) if agg.function == "min" else F.max(c)
    if agg.function == "avg":
        return F.avg((c * 10**kind.scale if kind.type is ValueType.DECIMAL else c).cast("double"))
    if kind.integer:
        # a sum of 34 bits leaves 64 bits after 2**30 rows of the greatest value
        return F.try_sum(c.cast("bigint")) if scope.bits.get(agg.column, 64) <= 34 else _exact_sum(c)
    if kind.type is ValueType.DECIMAL:
        total = F.sum(c.cast(f"decimal(28,{kind.scale})"))
        return total.try_cast(f"decimal(18,{kind.scale})")
    return F.sum(c.cast("double"))


#: Bits of the lower part of a summed integer: such parts of 2**39 rows add up
#: within 64 bits, and the upper parts do unless the sum doesn't.
_LOW = 24


def _exact_sum(c: Column) -> Column:
    """The sum of 64-bit integers, null beyond 64 bits, as two sums of 64 bits
    that stay in generated code: decimals of such width are objects."""
    c = c.cast("bigint")
    low, high = F.sum(c.bitwiseAND(F.lit((1 << _LOW) - 1))), F.try_sum(F.shiftright(c, _LOW))
    carried = high + F.shiftright(low, _LOW)
    fits = (carried >= -(1 << (63 - _LOW))) & (carried < 1 << (63 - _LOW))
    return F.when(fits, F.shiftleft(carried, _LOW) + low.bitwiseAND(F.lit((1 << _LOW) - 1)))


def shifted_sum(scope: Scope, column: str, by: int) -> Column:
    """The sum of a narrow integer column plus a number."""
    c = scope.column(column)
    return F.try_add(F.try_sum(c.cast("bigint")), F.try_multiply(F.count(c), F.lit(by).cast("bigint")))


def result_kind(agg: Agg, scope: Scope):
    if agg.function in ("count", "count_column", "count_distinct"):
        return I64
    if agg.function == "avg":
        return F64
    return scope.kind(agg.column)
