"""Predicates and scalars, lowered to Spark columns."""

from . import predicates as P
from . import scalars as S

__all__ = ["P", "S"]
