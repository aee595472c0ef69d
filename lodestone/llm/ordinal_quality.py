"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered: 0 (toxic), 1 (bad quality), 2 (good). One weight
vector over hashed features is shared by all grades; ordered thresholds cut
its score, P(grade <= j) = logistic(threshold[j] - score). A document gets its
expected grade and its tail probability P(grade >= at_least), by which it is
selected.

The model is fitted on a bounded sample of labelled rows (``max_labelled``, a
parameter), whose features reach the driver; the fitted weights have a fixed
size and travel with the tasks. Every document's whole text is scored.

Defined results: a null text counts as empty and is scored by the thresholds
alone; repeated rows keep a row each; ids without a label train nothing; with
no usable labels, or labels of one grade, the tail probability is 1 and the
expected grade the highest, as nothing speaks against any document; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, slices

BITS = 18
GRADES = 3
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_"
UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>"


def features(text: str | None, bits: int = BITS) -> list[int]:
    """Hashed features of a whole text, each once: words without the marks
    around them, and bins of a few shape ratios."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw.strip():
        return []
    words = raw.lower().split()
    kinds = set(words)
    chars = sum(map(len, words))
    share = lambda drop: 1 - len(raw.translate(None, drop)) / len(raw)
    shape = (
        b"\x00upper%d" % min(9, int(share(UPPER) * 10)), b"\x00symbol%d" % min(9, int(share(SYMBOLS) * 40)),
        b"\x00shout%d" % min(9, int(share(b"!") * 40)), b"\x00distinct%d" % int(len(kinds) / len(words) * 10),
        b"\x00size%d" % len(words).bit_length(), b"\x00width%d" % min(20, chars // len(words)),
    )
    mask, crc = (1 << bits) - 1, zlib.crc32
    return list({crc(w) & mask for w in {k.strip(EDGES) for k in kinds}} | {crc(s) & mask for s in shape})


def grade(quality: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    return np.where(toxic > 0, 0, np.where(quality == 0, 1, 2))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, 2**bits
    thresholds: np.ndarray  # ascending, one fewer than grades
    bits: int = BITS

    def score(self, text: str | None) -> float:
        return float(self.weights[features(text, self.bits)].sum())

    def below(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= j) for each score and each threshold."""
        return _logistic(self.thresholds[None, :] - scores[:, None])

    @staticmethod
    def fit(rows: list[list[int]], grades: np.ndarray, bits: int = BITS, steps: int = 150, rate: float = 0.3, ridge: float = 1e-4, least_rows: int = 5, telling: float = 40.0) -> OrdinalModel:
        """Fit by adaptive full gradients. Features in fewer than
        ``least_rows`` rows, or spread over the grades as chance would (by
        chi-squared), keep weight 0."""
        top = GRADES - 1
        if len(set(grades.tolist())) < 2:
            return OrdinalModel(np.zeros(1 << bits, np.float32), np.full(top, -40.0), bits)
        ids = np.fromiter((i for r in rows for i in r), np.int64)
        sizes = np.array([len(r) for r in rows])
        row = np.repeat(np.arange(len(rows)), sizes)
        n, by = len(rows), [np.bincount(ids[grades[row] == j], minlength=1 << bits) for j in range(GRADES)]
        count = np.maximum(1, sum(by))
        share = [(grades == j).mean() for j in range(GRADES)]
        chi = sum((b - count * q) ** 2 / (count * q) for b, q in zip(by, share, strict=True) if q)
        seen = (count >= least_rows) & (chi >= telling)
        ids, row = ids[seen[ids]], row[seen[ids]]
        below = np.array([(grades <= j).mean() for j in range(top)]).clip(0.5 / n, 1 - 0.5 / n)
        cut = np.maximum.accumulate(np.log(below / (1 - below)) + np.arange(top) * 1e-3)
        w, sum_w, sum_t = np.zeros(1 << bits), np.full(1 << bits, 1e-8), np.full(top, 1e-8)
        raw = np.r_[cut[0], np.log(np.maximum(np.diff(cut), 1e-3))]  # first threshold, logs of the gaps
        for _ in range(steps):
            cut = np.r_[raw[0], raw[0] + np.exp(raw[1:]).cumsum()]
            score = np.bincount(row, weights=w[ids], minlength=n)
            full = np.concatenate([np.zeros((n, 1)), _logistic(cut[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
            low, high = full[np.arange(n), grades], full[np.arange(n), grades + 1]
            p = np.maximum(high - low, 1e-12)
            g = np.bincount(ids, weights=((1 - low - high) / n)[row], minlength=1 << bits) + ridge * w
            at = np.zeros(top)
            np.add.at(at, grades[grades < top], (-high * (1 - high) / p)[grades < top] / n)
            np.add.at(at, grades[grades > 0] - 1, (low * (1 - low) / p)[grades > 0] / n)
            t = np.r_[at.sum(), [at[k:].sum() * np.exp(raw[k]) for k in range(1, top)]]
            sum_w += g * g
            sum_t += t * t
            w -= rate * g / np.sqrt(sum_w)
            raw -= rate * t / np.sqrt(sum_t)
        return OrdinalModel(w.astype(np.float32), np.r_[raw[0], raw[0] + np.exp(raw[1:]).cumsum()], bits)


def _featurise(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = pa.array([features(t, bits) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("toxic"), found], ["quality", "toxic", "ids"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12000, bits: int = BITS) -> OrdinalModel:
    """Fit on the documents of at most about ``max_labelled`` labels."""
    sample = labelled_sample(labels, max_labelled).withColumnRenamed("doc_id", "_id")
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("quality", "toxic", "text")
    rows = joined.mapInArrow(_featurise(bits), "quality int, toxic int, ids array<int>").toArrow()
    if not rows.num_rows:
        return OrdinalModel.fit([], np.zeros(0, np.int64), bits)
    grades = grade(rows["quality"].to_numpy(), rows["toxic"].to_numpy())
    return OrdinalModel.fit([r.values.to_numpy() for r in rows["ids"]], grades, bits)


def _score(model: OrdinalModel, at_least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            below = model.below(np.array([model.score(t) for t in batch.column("text").to_pylist()]))
            expected, tail = (1 - below).sum(axis=1), 1 - below[:, at_least - 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(tail)], ["doc_id", "expected_grade", "tail_probability"])

    return run


def select(docs: DataFrame, model: OrdinalModel, at_least: int = GRADES - 1, probability: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability and whether it is kept."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model, at_least), "doc_id bigint, expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= probability)
