"""The closed value model, and how it maps to Spark types."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from enum import Enum

from pyspark.sql import types as T

from .errors import DecimalScale, Refused, TypeMismatch


class ValueType(Enum):
    BOOL = "bool"
    BYTES = "bytes"
    STR = "str"
    I64 = "i64"
    U64 = "u64"
    DECIMAL = "decimal"
    F64 = "f64"
    UUID = "uuid"
    VECTOR = "vector"
    ARRAY = "array"


#: Digits that a decimal has in all: what a 64-bit count of units can hold.
DECIMAL_DIGITS = 18


@dataclass(frozen=True)
class Kind:
    """A type with what hangs on it: a decimal's scale, an array's element."""

    type: ValueType
    scale: int = 0
    element: ValueType | None = None

    @property
    def integer(self) -> bool:
        return self.type in (ValueType.I64, ValueType.U64)

    @property
    def numeric(self) -> bool:
        return self.integer or self.type in (ValueType.F64, ValueType.DECIMAL)

    def matches(self, other: Kind) -> bool:
        """Whether values of the two may be compared: one type, one scale."""
        return self == other or (self.integer and other.integer)

    def spark(self) -> T.DataType:
        if self.type is ValueType.ARRAY:
            return T.ArrayType(Kind(self.element or ValueType.STR).spark())
        return {
            ValueType.BOOL: T.BooleanType(), ValueType.BYTES: T.BinaryType(), ValueType.STR: T.StringType(), ValueType.I64: T.LongType(),
            ValueType.U64: T.LongType(), ValueType.F64: T.DoubleType(), ValueType.UUID: T.StringType(),
            ValueType.VECTOR: T.ArrayType(T.FloatType(), False), ValueType.DECIMAL: T.DecimalType(DECIMAL_DIGITS, self.scale),
        }[self.type]


BOOL, BYTES, STR, I64, U64, F64, UUID, VECTOR = (Kind(t) for t in (ValueType.BOOL, ValueType.BYTES, ValueType.STR, ValueType.I64, ValueType.U64, ValueType.F64, ValueType.UUID, ValueType.VECTOR))


def decimal(scale: int) -> Kind:
    return Kind(ValueType.DECIMAL, scale)


def array(element: ValueType) -> Kind:
    return Kind(ValueType.ARRAY, element=element)


def kind_of(t: T.DataType) -> Kind:
    """The kind of a Spark column."""
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.BinaryType):
        return BYTES
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return STR
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return I64
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F64
    if isinstance(t, T.DecimalType):
        return U64 if t.scale == 0 and t.precision == 20 else decimal(t.scale)
    if isinstance(t, T.ArrayType):
        return VECTOR if isinstance(t.elementType, T.FloatType) else array(kind_of(t.elementType).type)
    raise Refused(f"columns of type {t.simpleString()} are not in the value model; convert them when the table is loaded")


def literal_kind(value) -> Kind | None:
    """The kind of a Python value; None for null, which takes any."""
    if value is None:
        return None
    for python, kind in ((bool, BOOL), (int, I64), (float, F64), (str, STR), (bytes, BYTES)):
        if isinstance(value, python):
            return kind
    if isinstance(value, Decimal):
        return decimal(max(0, -value.as_tuple().exponent))
    if isinstance(value, (list, tuple)):
        first = next((literal_kind(x) for x in value if x is not None), None)
        return VECTOR if first is None or first == F64 else array(first.type)
    raise Refused(f"no value of the model: {value!r}")


def to_decimal(value, scale: int) -> Decimal:
    """Exactly ``value`` at ``scale``; digits beyond it must be zero."""
    exact = Decimal(str(value)) if not isinstance(value, Decimal) else value
    out = exact.quantize(Decimal(1).scaleb(-scale)) if exact.is_finite() else None
    if out is None or out != exact:
        raise DecimalScale(f"{value} does not fit a decimal of scale {scale}")
    if abs(out.scaleb(scale)) >= 1 << 63:
        raise DecimalScale(f"{value} is beyond the range of a decimal")
    return out


def adapt(value, kind: Kind):
    """A literal as a value of the column's kind, or a refusal."""
    if value is None:
        return None
    if kind.type is ValueType.DECIMAL and isinstance(value, (int, str, Decimal)) and not isinstance(value, bool):
        return to_decimal(value, kind.scale)
    if kind.type is ValueType.F64 and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    own = literal_kind(value)
    if kind.type is ValueType.UUID and own == STR:
        return value.lower()
    if not kind.matches(own):
        raise TypeMismatch(f"a {kind.type.value} is not compared with the {own.type.value} {value!r}")
    return value
