"""Sorting, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidCursor, Refused, TypeMismatch
from ..functions.predicates import Scope, literal
from ..plans.spec import Sort
from ..types import ValueType


def order_columns(order: tuple[Sort, ...], scope: Scope) -> list[Column]:
    out = []
    for s in order:
        if scope.kind(s.name).type is ValueType.VECTOR:
            raise TypeMismatch(f"{s.name} is a vector; rows are not ordered by vectors")
        c = scope.column(s.name)
        nulls = s.nulls or ("last" if s.descending else "first")
        if nulls not in ("first", "last"):
            raise Refused("nulls come first or last")
        out.append({(False, "first"): c.asc_nulls_first, (False, "last"): c.asc_nulls_last, (True, "first"): c.desc_nulls_first, (True, "last"): c.desc_nulls_last}[(s.descending, nulls)]())
    return out


def after(key: tuple[str, ...], cursor: tuple, scope: Scope, descending: bool = False) -> Column:
    """Rows whose key comes after the cursor, as bounds that reach the scan:
    the first column's bound, and the comparison of the whole key."""
    if len(cursor) != len(key):
        raise InvalidCursor(f"a cursor is a whole key: {', '.join(key)}")
    try:
        values = [literal(v, scope.kind(k)) for k, v in zip(key, cursor, strict=True)]
    except TypeMismatch as e:
        raise InvalidCursor(str(e)) from None
    out = F.lit(False)
    for k, v in zip(reversed(key), reversed(values), strict=True):
        c = scope.column(k)
        out = (c < v if descending else c > v) | ((c == v) & out)
    first = scope.column(key[0])
    return (first <= values[0] if descending else first >= values[0]) & out
