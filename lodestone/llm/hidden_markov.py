"""Language-model scoring with a hidden Markov model.

Tokens are words and one end a text. The model emits, from one of ``states``
latent states a token, the token's class, one of ``classes`` by hash, and then
the token itself given its class by smoothed counts:

    P(token | state) = P(class | state) * (c + 0.5) / (C + 0.5 V)

with c the token's count in the training texts and C and V the class's counts
of tokens and of distinct tokens. One class is the unknown token's alone. So
the model's tables have a fixed size, whatever the corpus, and travel with the
tasks, while counts are exact over the whole corpus and stay distributed.

Training is Baum-Welch: each pass over the corpus computes expected counts of
states, transitions and classes by the scaled forward and backward recursions,
sums them across partitions, one row a class, and re-estimates, until a pass
raises the log-likelihood by less than ``GAIN`` of it. Scoring is the
scaled forward recursion: the exact likelihood of the whole text, summed over
all state sequences.

The corpus is tokenised once, into blocks of about ``BLOCK_BYTES`` of text with
a dictionary each, in which the class of every word is kept; so a word that a
block holds often is one row in the count, a word of every document has one row
a block, and passes read class codes alone. Totals go back to the blocks in a
join on the word, but for the words that stand in more than one block of
``HOT_SHARE``: there are at most HOT_SHARE times as many of them as a mean block
has words, and the ``HOT_WORDS`` most frequent of them travel with the tasks.

The recursions run on emissions divided by the class shares, which stay near 1,
so that values need scaling at every ``RESCALE``-th token only; passes compute
in single precision and sum in double, scores are computed in double. Long
texts are one sequence: forward values are kept at every ``SEGMENT``-th token
and recomputed between.

Defined results: a null text counts as empty and is one end token; a null id
counts as training; repeated rows are scored, and counted, one by one; extra
columns are ignored; an empty table gives an empty result; without training
texts every token is unknown and scores 0, the one event there is.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, release, slices

STATES = 6
CLASSES = 1 << 14
#: Passes at the most and at the least, and the relative gain that ends training.
PASSES = 40
LEAST_PASSES = 6
GAIN = 1e-3
BLOCK_BYTES = 4 << 20
SEGMENT = 128
#: Tokens that one batch of sequences may hold, and tokens of the blocks whose
#: sequences are grouped together: steps cost little more for many sequences.
BATCH_TOKENS = 1 << 19
POOL_TOKENS = 1 << 22
#: Tokens between two scalings. A ratio of emission and class share lies between
#: 0.01 and 61 by the smoothing, so that single precision holds eight of them.
RESCALE = 8
HOT_SHARE = 8
HOT_WORDS = 1 << 18
END = b"\n"
LN10 = float(np.log(10))


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def class_of(token: bytes, classes: int) -> int:
    return zlib.crc32(token) % classes


BLOCKS = "block bigint, doc_ids array<bigint>, held array<boolean>, sizes array<int>, codes binary, kinds binary, words array<binary>, counts array<bigint>"


def _encode(classes: int):
    """Blocks: the ids, sizes and token codes of documents, and the tokens
    that codes stand for with their classes and their counts in the training
    texts. Codes take 16 bits where the block's dictionary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in slices(batches, "text", BLOCK_BYTES):
            known: dict[bytes, int] = defaultdict(count().__next__)
            held, codes = batch.column("held").to_pylist(), []
            for text in batch.column("text").to_pylist():
                own = tokens(text)
                codes.append(np.fromiter(map(known.__getitem__, own), np.uint32, len(own)))
            train = [c for c, h in zip(codes, held, strict=True) if not h]
            counts = np.bincount(np.concatenate(train) if train else np.zeros(0, np.int64), minlength=len(known))
            kinds = np.fromiter((class_of(w, classes) for w in known), np.uint16, len(known))
            row = {
                "block": (TaskContext.get().partitionId() << 32) + k, "doc_ids": batch.column("doc_id").to_pylist(), "held": held,
                "sizes": [len(c) for c in codes], "codes": np.concatenate(codes).astype(np.uint16 if len(known) <= 1 << 16 else np.uint32).tobytes(),
                "kinds": kinds.tobytes(), "words": list(known), "counts": counts.tolist(),
            }
            k += 1
            yield pa.RecordBatch.from_pylist([row], _BLOCKS)

    return run


_BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32()))]
    + [("codes", pa.binary()), ("kinds", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))]
)


@dataclass
class Model:
    start: np.ndarray  # states
    moves: np.ndarray  # states x states
    emits: np.ndarray  # classes + 1 x states, each state's column sums to 1

    def over(self, base: np.ndarray, kind: type) -> Model:
        """The model with emissions as multiples of the class shares."""
        ratio = np.divide(self.emits, base[:, None], out=np.zeros_like(self.emits), where=base[:, None] > 0)
        return Model(self.start.astype(kind), self.moves.astype(kind), ratio.astype(kind))

    @staticmethod
    def begin(base: np.ndarray, states: int, seed: int = 11) -> Model:
        """A start from the class shares: each state leans to classes of its
        own, strongly, and stays, so that texts fall to states as a whole."""
        lean = np.exp(np.random.default_rng(seed).normal(0, 1.0, (len(base), states)))
        emits = base[:, None] * (lean if states > 1 else 1)
        stay = 0.9 if states > 1 else 1.0
        moves = np.full((states, states), (1 - stay) / max(1, states - 1))
        np.fill_diagonal(moves, stay)
        return Model(np.full(states, 1 / states), moves, emits / emits.sum(axis=0))

    def learn(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, base: np.ndarray, strength: float) -> Model:
        """The model re-estimated from expected counts, drawn to the class
        shares by ``strength`` tokens a state, so that no event is impossible.
        The unknown class, of which there is nothing to count, keeps its share
        in every state."""
        s, m = starts + 0.5, moves + 0.5
        e = emits + strength * base[:, None]
        e[-1] = 0
        e *= (1 - base[-1]) / e.sum(axis=0)
        e[-1] = base[-1]
        return Model(s / s.sum(), m / m.sum(axis=1, keepdims=True), e)


def batches_of(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences in groups of like sizes, longest first in each group."""
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(1024, BATCH_TOKENS // max(1, int(sizes[order[at]]))))
        yield order[at : at + n]
        at += n


def _padded(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """time x sequence; sequences come longest first."""
    at = np.arange(int(sizes[0]))[:, None] + begins[None, :]
    return codes[np.minimum(at, len(codes) - 1)]


def _live(sizes: np.ndarray, length: int) -> np.ndarray:
    """How many sequences are longer than each t."""
    return np.searchsorted(-sizes, -np.arange(length), side="left")


def forward(model: Model, seqs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural logs of the likelihoods of class sequences (time x sequence)."""
    out, alpha = np.zeros(len(sizes)), model.start[None, :].repeat(len(sizes), 0)
    live = _live(sizes, len(seqs)).tolist()
    for at in range(0, len(seqs), SEGMENT):
        emitted = np.take(model.emits, seqs[at : at + SEGMENT], axis=0)
        for t in range(len(emitted)):
            n = live[at + t]
            if n < len(alpha):
                out[n : len(alpha)] += np.log(alpha[n:].sum(axis=1))
                alpha = alpha[:n]
            alpha = (alpha @ model.moves if at + t else alpha) * emitted[t, :n]
            if t % RESCALE == 0:
                scale = alpha.sum(axis=1)
                out[:n] += np.log(scale)
                alpha /= scale[:, None]
    out[: len(alpha)] += np.log(alpha.sum(axis=1))
    return out


def _expect_whole(model: Model, seqs: np.ndarray, sizes: np.ndarray, add: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """``expect`` with all forward and backward values kept: what is not part
    of the recursions is then done for all tokens at once."""
    starts, moves, emits = add
    (length, width), k, live = seqs.shape, len(model.start), _live(sizes, len(seqs)).tolist()
    emitted = np.take(model.emits, seqs, axis=0)
    alphas, betas, total = np.zeros_like(emitted), np.zeros_like(emitted), 0.0
    alpha = alphas[0]
    np.multiply(model.start[None, :], emitted[0], out=alpha)
    for t in range(1, length):
        n = live[t]
        new = alphas[t, :n]
        np.matmul(alpha[:n], model.moves, out=new)
        new *= emitted[t, :n]
        if t % RESCALE == 0:
            scale = new.sum(axis=1, keepdims=True)
            total += float(np.log(scale).sum(dtype=np.float64))
            new /= scale
            emitted[t, :n] /= scale
        alpha = new
    ends = alphas[sizes - 1, np.arange(width)].sum(axis=1)
    total += float(np.log(ends).sum(dtype=np.float64))
    last, back, n, met = np.repeat(1 / ends[:, None], k, axis=1), np.ascontiguousarray(model.moves.T), 0, np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        beta = betas[t]
        if n:
            np.matmul(emitted[t + 1, :n], back, out=beta[:n])
            met += alphas[t, :n].T @ emitted[t + 1, :n]
        beta[n : live[t]] = last[n : live[t]]
        n = live[t]
        emitted[t, :n] *= beta[:n]
    moves += model.moves * met
    alphas *= betas  # cells beyond a sequence's end have values of 0
    starts += alphas[0].sum(axis=0, dtype=np.float64)
    flat, gamma = seqs.reshape(-1), alphas.reshape(-1, k).T.astype(np.float64, order="C")
    for j in range(k):
        emits[:, j] += np.bincount(flat, weights=gamma[j], minlength=len(emits))
    return total


def expect(model: Model, seqs: np.ndarray, sizes: np.ndarray, add: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Add the expected counts (starts, moves, emits) of the sequences, and
    return the log-likelihood. For more tokens than a batch has, a very long
    text, forward values are kept at segment starts alone."""
    if seqs.size <= BATCH_TOKENS:
        return _expect_whole(model, seqs, sizes, add)
    starts, moves, emits = add
    length, n_all, k = len(seqs), len(sizes), len(model.start)
    live = _live(sizes, length)
    total = 0.0

    def step(alpha: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        a = (alpha[: live[t]] @ model.moves if t else alpha[: live[t]]) * model.emits[seqs[t, : live[t]]]
        scale = a.sum(axis=1)
        return a / scale[:, None], scale

    first = model.start[None, :].repeat(n_all, 0)
    kept, alpha = [], first
    for t in range(length):
        if t % SEGMENT == 0:
            kept.append(alpha)
        alpha, scale = step(alpha, t)
        total += float(np.log(scale).sum())
    beta = np.ones((0, k))
    for s in range(len(kept) - 1, -1, -1):
        t0, t1 = s * SEGMENT, min(length, (s + 1) * SEGMENT)
        alphas, scales, alpha = [], [], kept[s]
        for t in range(t0, t1):
            alpha, scale = step(alpha, t)
            alphas.append(alpha)
            scales.append(scale)
        gammas, ids = [], []
        for t in range(t1 - 1, t0 - 1, -1):
            n = live[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), k))])
            gamma = alphas[t - t0] * beta
            gammas.append(gamma)
            ids.append(seqs[t, :n])
            back = model.emits[seqs[t, :n]] * beta / scales[t - t0][:, None]
            if t:
                before = (alphas[t - t0 - 1] if t > t0 else kept[s])[:n]
                moves += model.moves * (before.T @ back)
                beta = back @ model.moves.T
            else:
                starts += gamma.sum(axis=0)
        flat, gamma = np.concatenate(ids), np.concatenate(gammas)
        for j in range(k):
            emits[:, j] += np.bincount(flat, weights=gamma[:, j], minlength=len(emits))
    return total


def _codes(block: dict) -> np.ndarray:
    return np.frombuffer(block["codes"], np.uint16 if len(block["codes"]) == 2 * sum(block["sizes"]) else np.uint32)


def _kinds(block: dict) -> np.ndarray:
    return np.frombuffer(block["kinds"], np.uint16).astype(np.int32)


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Blocks of about ``POOL_TOKENS`` tokens together."""
    pool, size = [], 0
    for batch in batches:
        for block in batch.to_pylist():
            pool.append(block)
            size += sum(block["sizes"])
            if size >= POOL_TOKENS:
                yield pool
                pool, size = [], 0
    if pool:
        yield pool


def _expected(model: Model, classes: int):
    """Rows (class, state counts...): the sums of a partition; class -1 holds
    the starts, -2 - i the moves from state i, -2 - states the likelihood, as a
    multiple of the class shares' one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.start)
        add = (np.zeros(k), np.zeros((k, k)), np.zeros((classes + 1, k)))
        total = 0.0
        for pool in _pools(batches):
            seq = np.concatenate([_kinds(b)[_codes(b)] for b in pool])
            sizes, held = np.array([n for b in pool for n in b["sizes"]]), np.array([h for b in pool for h in b["held"]], bool)
            begins, train = np.r_[0, sizes.cumsum()[:-1]], np.flatnonzero(~held)
            for group in batches_of(sizes[train]):
                own = train[group]
                total += expect(model, _padded(seq, begins[own], sizes[own]), sizes[own], add)
        used = np.flatnonzero(add[2].sum(axis=1))
        names = np.r_[used, -1, -2 - np.arange(k), -2 - k]
        rows = np.concatenate([add[2][used], add[0][None], add[1], np.r_[total, np.zeros(k - 1)][None]])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *[pa.array(np.ascontiguousarray(rows[:, j])) for j in range(k)]], ["c", *[f"s{j}" for j in range(k)]])

    return run


@dataclass
class Scorer:
    """A fitted model, the counts behind it, and the blocks of the corpus."""

    model: Model
    classes: int
    n: int  # tokens in the training texts
    v: int  # distinct ones
    class_tokens: np.ndarray
    class_kinds: np.ndarray
    base: np.ndarray  # the share of each class in the training texts, smoothed
    blocks: Stored
    counts: Stored  # word, c, and the blocks m that hold it
    likelihoods: list[float]


def _every(blocks: DataFrame, *carried: str) -> DataFrame:
    """A row for each word of each block, with its place in the dictionary."""
    own = [c for c in carried if c == "block"]
    x = F.arrays_zip("words", "counts") if "counts" in carried else F.arrays_zip("words")
    out = blocks.select(*own, F.posexplode(x).alias("at", "x"))
    return out.select(*own, "at", F.col("x.words").alias("word"), *[F.col(f"x.{c}") for c in carried if c not in own])


def fit(docs: DataFrame, held: str = "held", states: int = STATES, classes: int = CLASSES, passes: int = PASSES, smoothing: float = 0.1, gain: float = GAIN) -> Scorer:
    """Count and train over all documents whose ``held`` is not true, for
    ``passes`` at the most.

    ``smoothing``: the weight of the class shares, in tokens of a mean state."""
    if classes > 1 << 16:
        raise ValueError("classes are kept in 16 bits")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(held), F.lit(False)).alias("held"))
    blocks = Stored(rows.mapInArrow(_encode(classes), BLOCKS), "token-blocks")
    every = _every(blocks.df, "counts")
    totals = Stored(every.groupBy("word").agg(F.sum("counts").alias("c"), F.count(F.lit(1)).alias("m")).where("c > 0"), "word-counts")
    release(spark)
    by_class = totals.df.groupBy((F.crc32("word") % classes).cast("int").alias("k"))
    found = by_class.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow()  # a row a class
    c, v = np.zeros(classes + 1), np.zeros(classes + 1)
    if found.num_rows:
        c[found["k"].to_numpy()], v[found["k"].to_numpy()] = found["c"].to_numpy(), found["v"].to_numpy()
    n, kinds = int(c.sum()), int(v.sum())
    base = (c + 0.5 * v) / (n + 0.5 * (kinds + 1))
    base[classes] = 0.5 / (n + 0.5 * (kinds + 1))
    by_shares = float((c[c > 0] * np.log(base[c > 0])).sum())  # the log-likelihood of the class shares alone
    model, likelihoods = Model.begin(base, states), []
    names = [f"s{j}" for j in range(states)]
    for _ in range(passes if n else 0):
        parts = blocks.df.select("held", "sizes", "codes", "kinds").mapInArrow(_expected(model.over(base, np.float32), classes), "c int, " + ", ".join(f"{x} double" for x in names))
        got = parts.groupBy("c").agg(*[F.sum(x).alias(x) for x in names]).toArrow()  # a row a class
        key, sums = got["c"].to_numpy(), np.stack([got[x].to_numpy() for x in names], axis=1)
        emits = np.zeros((classes + 1, states))
        emits[key[key >= 0]] = sums[key >= 0]
        at = {int(x): sums[i] for i, x in enumerate(key) if x < 0}
        likelihoods.append(float(at[-2 - states][0]) + by_shares)
        model = model.learn(at[-1], np.stack([at[-2 - i] for i in range(states)]), emits, base, smoothing * n / states)
        if len(likelihoods) >= LEAST_PASSES and likelihoods[-1] - likelihoods[-2] < gain * abs(likelihoods[-2]):
            break
    return Scorer(model, classes, n, kinds, c, v, base, blocks, totals, likelihoods)


def _score(s: Scorer):
    model, classes, n, v, tokens_of, kinds_of = s.model.over(s.base, np.float64), s.classes, s.n, s.v, s.class_tokens, s.class_kinds
    shares = np.log10(np.where(s.base > 0, s.base, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in _pools(batches):
            ids, held = [i for b in pool for i in b["doc_ids"]], [h for b in pool for h in b["held"]]
            sizes = np.array([m for b in pool for m in b["sizes"]])
            seqs, bases, withins, hits = [], [], [], []
            for b in pool:
                codes, kinds = _codes(b), _kinds(b)
                c = np.zeros(len(kinds))
                if b["at"]:
                    c[b["at"]] = b["c"]
                cls = np.where(c > 0, kinds, classes)
                own = np.array(b["sizes"])
                at = np.r_[0, own.cumsum()[:-1]]
                within = np.where(c > 0, np.log10((c + 0.5) / np.maximum(tokens_of[cls] + 0.5 * kinds_of[cls], 0.5)), 0.0) + shares[cls]
                bases.append(np.add.reduceat(np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[codes], at))
                withins.append(np.add.reduceat(within[codes], at))
                hits.append(np.add.reduceat((c > 0).astype(np.int64)[codes], at))
                seqs.append(cls.astype(np.int32)[codes])
            score, seq, begins = np.concatenate(withins), np.concatenate(seqs), np.r_[0, sizes.cumsum()[:-1]]
            for own in batches_of(sizes):
                score[own] += forward(model, _padded(seq, begins[own], sizes[own]), sizes[own]) / LN10
            arrays = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes.astype(np.int64)), pa.array(np.concatenate(hits)), pa.array(np.full(len(sizes), n)), pa.array(np.concatenate(bases)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(s: Scorer) -> DataFrame:
    """Scores, in log10, of all documents of the fitted corpus."""
    blocks = s.blocks.df
    every = _every(blocks, "block")
    most = blocks.count() // HOT_SHARE
    hot = s.counts.df.where(F.col("m") > most).orderBy(F.desc("m"), "word").limit(HOT_WORDS).select("word", F.col("c").alias("hot"))
    told = every.join(F.broadcast(hot), "word", "left")
    rest = told.where("hot is null").drop("hot").join(s.counts.df.select("word", "c"), "word")
    both = told.where("hot is not null").select("block", "at", F.col("hot").alias("c")).unionByName(rest.select("block", "at", "c"))
    counts = both.groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("x")).select("block", "x.at", "x.c")
    met = blocks.select("block", "doc_ids", "held", "sizes", "codes", "kinds").join(counts, "block", "left").drop("block")
    return met.mapInArrow(_score(s), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def report(docs: DataFrame, **options) -> DataFrame:
    """Score all documents, learning from those whose crc32(doc_id) mod 5 is
    not 1."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score(fit(docs.select("doc_id", "text", held.alias("held")), **options))
