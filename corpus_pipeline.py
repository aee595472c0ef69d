"""From raw documents to token files, in five stages.

Each stage gets the table that the one before has written, and works on all of
it. ``run`` does them in turn over ``documents``. What a stage keeps for itself
in the shared folder, its result still reads; it is deleted when the next stage
is called, which gets that result written.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import quality_rules, simhash_vptree, soft_mixing, string_tiling, token_output
from lodestone.llm.common import Stored, drop_stored, release, table
from lodestone.llm.queries import tokenizer_path

#: Shares of tokens. Sound documents keep their total; the other domains are
#: thinned out to what the shares leave them.
TARGETS = {"good": 0.98, "toxic": 0.01, "low": 0.01}

#: Near copies: texts whose sets of five-word shingles have this Jaccard
#: similarity. Fingerprints of such texts differ in about 10 of 64 bits, of short
#: ones in up to twice that; the radius lets all but a few through to be compared.
SIMILAR, SHINGLE, RADIUS = 0.8, 5, 24

#: SQL cannot express the learned stages; tests hold them to brute force.
ORACLE_SQL = None


#: Paths of what the last stage keeps.
_left: set[str] = set()


def _freeing(stage):
    """The stage, after what the one before kept is deleted."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stored({x.path for x in Stored.kept} - _left)
        release(spark)
        others = {x.path for x in Stored.kept}
        out = stage(spark, docs, sf_dir)
        _left.clear()
        _left.update({x.path for x in Stored.kept} - others)
        return out

    return run


@_freeing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rule or a learned one go."""
    return quality_rules.filter_documents(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


@_freeing
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash_vptree.keep_one(docs, RADIUS, SHINGLE, SIMILAR)


@_freeing
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return string_tiling.clean(docs, table(spark, sf_dir, "benchmark"))


@_freeing
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document stays by its fitted rate."""
    labelled = soft_mixing.domain_labels(table(spark, sf_dir, "labels"), 20000)
    return soft_mixing.apply(docs, labelled, TARGETS, anchor="good", max_rate=1.0)


@_freeing
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token output: packed files, and what they say of each document."""
    return token_output.read_back(token_output.write_blocks(docs, tokenizer_path(), end_id=2).df)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    Rows are told apart by row, not id: documents whose ids are null or repeat
    go through like others. A null or empty text fails the quality rules, and an
    empty table gives an empty result; all columns are carried, whatever their
    names, up to the last stage."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = Stored(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
        if before:
            before.drop()
        docs, before = out.df, out
    return STAGES[-1][1](spark, docs, sf_dir)
