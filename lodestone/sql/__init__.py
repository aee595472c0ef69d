"""A subset of SQL that lowers to query specifications."""

from .parser import parse
from .run import run

__all__ = ["parse", "run"]
