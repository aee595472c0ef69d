"""Related rows: has-many, belongs-to, through, nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused

MOST_DEPTH = 4


def _listed(df: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    rest = F.struct(*[F.col(f"`{c}`") for c in [*order, *(c for c in df.columns if c not in order)]])
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(rest)).alias(name))


def load_related(parents: DataFrame, children: DataFrame, on: list[tuple[str, str]], name: str, order: list[str]) -> DataFrame:
    """Parents with a list of their children, by ``order``; none is an empty
    list. Children without a key belong to nobody."""
    keys = [f"_k{i}" for i in range(len(on))]
    kept = children
    for _, c in on:
        kept = kept.where(F.col(f"`{c}`").isNotNull())
    kept = kept.select("*", *[F.col(f"`{c}`").alias(k) for k, (_, c) in zip(keys, on, strict=True)])
    rest = F.struct(*[F.col(f"`{c}`") for c in [*order, *(c for c in children.columns if c not in order)]])
    lists = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(rest)).alias(name))
    condition = [parents[f"`{p}`"] == lists[k] for k, (p, _) in zip(keys, on, strict=True)]
    out = parents.join(lists, condition, "left").drop(*keys)
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def load_one_related(children: DataFrame, parents: DataFrame, on: list[tuple[str, str]], name: str) -> DataFrame:
    """Children with their parent as a struct, null if there is none."""
    whole = parents.select(F.struct(*[F.col(f"`{c}`") for c in parents.columns]).alias(name))
    condition = [children[f"`{c}`"] == whole[f"{name}.{p}"] for c, p in on]
    return children.join(whole, condition, "left")


def load_through(parents: DataFrame, links: DataFrame, targets: DataFrame, left: tuple[str, str], right: tuple[str, str], name: str, order: list[str]) -> DataFrame:
    """Parents with the targets that a link table leads to, each once.
    ``left``: (parent's column, link's); ``right``: (link's, target's)."""
    pairs = links.select(F.col(f"`{left[1]}`").alias("_p"), F.col(f"`{right[0]}`").alias("_t")).distinct()
    met = pairs.join(targets, pairs["_t"] == targets[f"`{right[1]}`"]).drop("_t")
    return load_related(parents, met, [(left[0], "_p")], name, order)


def load_nested(levels: list[tuple[DataFrame, list[tuple[str, str]], str, list[str]]], parents: DataFrame) -> DataFrame:
    """Children of children: one join a level, from the deepest up. Each
    level: rows, keys to the level above, name of the list, order."""
    if len(levels) > MOST_DEPTH:
        raise Refused(f"relations are nested {MOST_DEPTH} deep at the most")
    frames = [parents, *(df for df, *_ in levels)]
    below = None
    for i in range(len(levels) - 1, -1, -1):
        df = below if below is not None else frames[i + 1]
        _, on, name, order = levels[i]
        below = load_related(frames[i], df, on, name, order)
    return below if below is not None else parents
