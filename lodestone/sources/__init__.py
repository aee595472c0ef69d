"""Where tables come from, and versioned tables that can be written."""

from .tables import hits_defaults, load, memory, seed_toml, with_epoch_seconds
from .versioned import VersionedTable, publish

__all__ = ["VersionedTable", "hits_defaults", "load", "memory", "publish", "seed_toml", "with_epoch_seconds"]
