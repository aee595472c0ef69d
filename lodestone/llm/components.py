"""Connected components of a table of links, without collecting it.

Alternating large-star and small-star steps: every node's larger (then
smaller) neighbours are linked to the least node it knows, until each
component is a star around its least node. Rounds grow with the logarithm of
the longest chain; each round is written to the shared folder, so that lineage
stays short and lost executors cost one round at the most. A hub, a node that a
large share of the links meets, is joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, join_counted


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    return (
        join_counted(both, _least(both), ["u"], "n", 2 * n).where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()
    )


def _small_star(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = _least(down)
    return (
        join_counted(down, least, ["u"], "n", n).where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        .union(least.select("u", "m")).distinct()
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the least node of its
    component. A node without links is in no row."""
    def mark() -> tuple:
        return tuple(kept.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    kept = Stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = mark()
    for _ in range(most_rounds):
        large = Stored(_large_star(kept.df, now[0]), "links", 2 * now[0])
        kept.drop()
        kept = Stored(_small_star(large.df, now[0]), "links", 2 * now[0])
        large.drop()
        before, now = now, mark()
        if now == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    stars = kept.df.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(stars.select("label", "label").distinct())
