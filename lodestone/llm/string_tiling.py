"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are candidates if they share a seed, a run of
``least`` words. A pair is tiled: the longest match between words not yet
marked on either side becomes a tile and is marked, again and again, down to
``least`` words. Matches are found by running Karp-Rabin, at search lengths
that halve from the longest. The tiles may stand in any order, so reordered
passages are caught; an item is found in a document if its tiles cover at
least ``coverage`` of its words.

Words are lower-cased in A-Z and lose the marks around them. An item of fewer
than ``least`` words is matched only as a whole. A benchmark of at most
``BROADCAST_WORDS`` words and ``BROADCAST_BYTES`` bytes (counted first) travels
with the tasks; a larger one meets the documents in a join of the hashes of
seeds, after a bitmap of bounded size has dropped most seeds of documents that
no item has. Both ways judge each row by its own text, whatever its id.

Defined results: a null or empty text, on either side, matches nothing;
repeated items and documents are each reported; null ids are carried along;
extra columns are ignored by ``find`` and carried by ``clean``; empty tables
give no pairs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, bitmap, join_counted, marked, slices, with_rid

LEAST = 5
COVERAGE = 0.5
BROADCAST_WORDS = 2_000_000
BROADCAST_BYTES = 32 << 20
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_"
BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    out = [w.strip(EDGES) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    return [w for w in out if w]


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, mod 2**64."""

    def of(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return of(BASE), of(pow(BASE, -1, 1 << 64))


class Rolling:
    """Karp-Rabin hashes, mod 2**64, of the runs of ids at any length: sums
    roll over the ids once, and each length takes differences of them."""

    def __init__(self, ids: np.ndarray):
        x = (ids.astype(np.int64) + 2).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        power, self.back = _powers(1 << max(1, len(ids)).bit_length())
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)]

    def of(self, n: int) -> np.ndarray:
        h = self.sums[n:] - self.sums[: max(0, len(self.sums) - n)]
        return h * self.back[: len(h)]


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` ids."""
    return Rolling(ids).of(n)


def _free_runs(marked: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` from each place is free of marks."""
    total = np.r_[0, marked.cumsum()]
    return total[n:] == total[:-n]


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words), longest first.

    Ids that differ are different words; a negative id matches nothing."""
    tiles: list[tuple[int, int, int]] = []
    done_d, done_i = doc < 0, item < 0
    length, in_doc, in_item = min(len(doc), len(item)), Rolling(doc), Rolling(item)
    while length >= least:
        hd, hi = in_doc.of(length), in_item.of(length)
        pd, pi = (np.nonzero(_free_runs(m, length))[0] for m in (done_d, done_i))
        order = pi[np.argsort(hi[pi], kind="stable")]
        a, b = (np.searchsorted(hi[order], hd[pd], side=s) for s in ("left", "right"))
        queue, reach = [], {}
        for at in np.nonzero(b > a)[0]:
            i = int(pd[at])
            for j in map(int, order[a[at] : b[at]]):
                if i < reach.get(i - j, -1) or not np.array_equal(doc[i : i + length], item[j : j + length]):
                    continue
                n, most = length, min(len(doc) - i, len(item) - j)
                while n < most and doc[i + n] == item[j + n] and not done_d[i + n] and not done_i[j + n]:
                    n += 1
                reach[i - j] = i + n - length + 1
                queue.append((-n, j, i))
        heapq.heapify(queue)
        while queue:
            n, j, i = heapq.heappop(queue)
            free = ~(done_d[i : i - n] | done_i[j : j - n])
            if free.all():
                done_d[i : i - n] = done_i[j : j - n] = True
                tiles.append((i, j, -n))
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
            for x, y in zip(edges[::2], edges[1::2], strict=True):
                if y - x >= length:
                    heapq.heappush(queue, (int(x - y), j + int(x), i + int(x)))
        length = least if least < length < 2 * least else length // 2
    return tiles


class _Ids(dict):
    """Ids of words as they stand in texts: -1 if no item has the word, -2 if
    nothing is left of it. Remembers what it has met, up to a bound."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        bare = word.strip(EDGES)
        self[word] = out = self.vocabulary.get(bare, -1) if bare else -2
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out[out != -2]


class Benchmark:
    """Items, their words as ids, and the seeds that lead to them."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int = LEAST, coverage: float = COVERAGE):
        self.least, self.coverage = least, coverage
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for key, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int64)
            if len(ids):
                n = min(least, len(ids))
                for h in rolling(ids, n).tolist():
                    seeds[n][h].add(len(self.items))
                self.items.append((key, ids))
        self.ids = _Ids(self.vocabulary)
        self.seeds = {n: (np.array(sorted(s), np.uint64), s) for n, s in seeds.items()}

    def candidates(self, ids: np.ndarray) -> set[int]:
        """Items that share a seed with a document."""
        found: set[int] = set()
        own = Rolling(ids)
        for n, (hashes, items) in self.seeds.items():
            if len(ids) >= n:
                run = own.of(n)[_free_runs(ids < 0, n)]
                if len(run):
                    at = np.searchsorted(hashes, run).clip(max=len(hashes) - 1)
                    for h in set(run[hashes[at] == run].tolist()):
                        found |= items[h]
        return found

    def search(self, text: str | None) -> list[dict]:
        """The items that the tiles of a whole text cover well enough."""
        ids = self.ids.of(text)
        out = []
        for k in sorted(self.candidates(ids)) if len(ids) else ():
            key, item = self.items[k]
            tiles = tile(ids, item, min(self.least, len(item)))
            covered = sum(n for _, _, n in tiles)
            if tiles and covered >= self.coverage * len(item):
                out.append(
                    {"item_id": key, "item_words": len(item), "tiled_words": covered, "n_tiles": len(tiles), "coverage": covered / len(item),
                     "first_word": min(i for i, _, _ in tiles), "end_word": max(i + n for i, _, n in tiles)}
                )
        return out


PAIRS = "doc_id bigint, item_id bigint, item_words int, tiled_words int, n_tiles int, coverage double, first_word int, end_word int"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64())] + [(c, pa.int32()) for c in ("item_words", "tiled_words", "n_tiles")]
    + [("coverage", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())]
)


def _find(bench: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [{"doc_id": d, **x} for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in bench.search(t)]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def _small(items: DataFrame, least: int, coverage: float, most: int) -> Benchmark | None:
    """The benchmark, if it is small enough to travel with the tasks."""
    text = F.coalesce("text", F.lit(""))
    size = items.agg(F.sum(F.size(F.split(text, r"[\x20\x09-\x0D]+"))).alias("words"), F.sum(F.octet_length(text)).alias("bytes")).first()
    if (size["words"] or 0) > most or (size["bytes"] or 0) > BROADCAST_BYTES:
        return None
    return Benchmark([(r[0], r[1]) for r in items.select(F.col("item_id").cast("long"), "text").collect()], least, coverage)


def _seeds(lengths: list[int], least: int, whole: bool, known=None):
    """(rid, seed): the distinct runs of words, at the lengths that items have
    seeds of, by hash. ``whole``: of items, whose text may be shorter than
    ``least``; else those of documents that the bitmap ``known`` lets through."""

    def of(text: str | None) -> np.ndarray:
        import xxhash

        words = words_of(text)
        ids = Rolling(np.array([xxhash.xxh64_intdigest(w) >> 2 for w in words], np.int64))
        found = [ids.of(n) for n in ([min(least, len(words))] if whole else lengths) if 0 < n <= len(words)]
        out = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        return out if known is None else out[marked(known.value, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [of(t) for t in batch.column("text").to_pylist()]
            rid = np.repeat(batch.column("rid").to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["rid", "seed"])

    return run


def _find_by_join(rows: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """Seeds meet in a shuffle; candidate pairs then fetch their texts. Rows
    and items are told apart by row number, which the result has as ``rid``."""
    d = rows.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    i = with_rid(items.select("item_id", "text"), "items").df.select("rid", F.col("row.item_id").cast("long").alias("item_id"), F.col("row.text").alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([min(least, len(words_of(t))) for t in batch.column("text").to_pylist()], pa.int32())], ["n"])

    lengths = [r["n"] for r in i.select("text").mapInArrow(sizes, "n int").where("n > 0").distinct().collect()]  # ``least`` numbers at the most
    schema = "rid bigint, seed bigint"
    of_items = Stored(i.select("rid", "text").mapInArrow(_seeds(lengths, least, True), schema).withColumnRenamed("rid", "item"), "item-seeds").df
    known = bitmap(of_items.select(F.col("seed").alias("h")), of_items.count())
    of_docs = Stored(d.select("rid", "text").mapInArrow(_seeds(lengths, least, False, known), schema), "document-seeds").df
    # a passage that many documents share is a hot seed
    often = of_docs.groupBy("seed").agg(F.count(F.lit(1)).alias("m"))
    facts = of_items.groupBy("seed").agg(F.collect_set("item").alias("items")).join(often, "seed")
    pairs = join_counted(of_docs, facts, ["seed"], "m", of_docs.count()).select("rid", F.explode("items").alias("item")).distinct()
    met = pairs.join(d, "rid").join(i.select(F.col("rid").alias("item"), "item_id", F.col("text").alias("item_text")), "item").select("rid", "doc_id", "text", "item_id", "item_text")

    def tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [{"rid": r["rid"], "doc_id": r["doc_id"], **x} for r in batch.to_pylist() for x in Benchmark([(r["item_id"], r["item_text"])], least, coverage).search(r["text"])]
            yield pa.RecordBatch.from_pylist(found, _ARROW.insert(0, pa.field("rid", pa.int64())))

    return met.mapInArrow(tile_pairs, "rid bigint, " + PAIRS)


def find(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    bench = _small(items, least, coverage, broadcast_words)
    if bench is None:
        return _find_by_join(with_rid(docs.select("doc_id", "text"), "tiling-rows").df, items, least, coverage).drop("rid")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(bench), PAIRS)


def clean(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows in whose text no benchmark item is found, with all columns."""
    bench = _small(items, least, coverage, broadcast_words)
    if bench is None:
        rows = with_rid(docs, "tiling-rows").df
        found = _find_by_join(rows, items, least, coverage).select("rid").distinct()
        return rows.join(found, "rid", "left_anti").select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([not bench.search(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
