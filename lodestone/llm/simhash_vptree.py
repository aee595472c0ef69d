"""SimHash near-dedup with a sharded vantage-point tree.

Fingerprints are partitioned by Hamming distance: each inner node of the tree
has a vantage fingerprint and a radius, and sends what is nearer to one side
and the rest to the other; the leaves are the shards. The levels measure the
distance on disjoint groups of bits. By the triangle inequality two
fingerprints on two sides of a boundary differ in at least as many bits of
that group as the boundary is away, and as groups are disjoint these bounds
add up along a path. A fingerprint therefore needs to be looked for only in
the shards that it reaches with a total of at most ``distance`` bits, and of
two shards only in the later one; in a shard all pairs are compared exactly.

The tree is built from a bounded sample (``SAMPLE``); every fingerprint is
indexed. Equal fingerprints are one entry. Shards of more than ``PIECE``
entries are compared in tiles, each of two pieces, so that no task meets an
unbounded group. A shard returns a spanning forest of its links, never all
pairs.

With ``similar`` a link also needs that Jaccard similarity of the two sets of
shingles. The tree finds all fingerprints within ``REACH`` bits, whatever their
shingles, as without it. Similarity 0.8 is about 10 of 64 bits and often 16, a
radius at which the tree prunes next to nothing. Beyond ``REACH``, up to
``distance``, further candidates are therefore fingerprints that share a bucket, one of ``BANDS`` keys of two min-wise shingles
each (of pairs at 0.8, all but 0.36 ** 8 = 0.03 % share one), and sets of
shingle hashes are compared exactly. In a shard or a bucket a fingerprint is compared with
all others, and its ``NEAREST`` nearest and the first within distance
are candidates, so that a large group of near copies is linked through
neighbours, not pair by pair. What this leaves out is then compared too: rows
of a shard, or of a bucket of more than ``NEAREST`` others, that are still in
different components, and within distance of one another, have all their sets compared
(``rest_links``), so that no link between components is lost.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, linked like any other; rows with equal or null ids are rows
of their own (the component's id is the least id that is not null, null if
there is none); an empty table gives an empty result; extra columns are ignored
by ``components_of`` and carried by ``keep_one``, which tells rows apart by a
stored row number, not by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, bitmap, drop_stored, join_counted, marked, release, slices, with_rid
from .components import components

SAMPLE = 1 << 20
LEAF = 1024
PIECE = 8192
#: So that the least node has some 16 fingerprints of the sample.
MOST_LEVELS = 16
#: Row numbers, or keys, that are broadcast at the most.
BROADCAST_ROWS = 1 << 20
DISTANCE = 2
SHINGLE = 3
#: Bits that the tree searches, all of them, where sets of shingles decide.
REACH = 3
BANDS = 8
NEAREST = 8
#: Bytes of shingle sets in a piece of a bucket whose sets are all compared.
PIECE_BYTES = 16 << 20


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; a shorter text is one."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    h, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """64-bit SimHash of the XXH64 of word shingles, repeats included."""
    return simhash(shingle_hashes(text, shingle, seed))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(found.view(np.int64))], ["rid", "doc_id", "fp"])

    return run


def _texts(docs: DataFrame, rid: Column) -> DataFrame:
    return docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def fingerprints(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    return texts.mapInArrow(_fingerprints(shingle), "rid bigint, doc_id bigint, fp bigint")


_MIX = np.random.default_rng(3).integers(1, 1 << 63, (3, 2 * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of the buckets that a set of shingle hashes stands in."""
    least = np.full(2 * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1 << 14):
        x = (hashes[None, at : at + (1 << 14)] ^ _MIX[0]) * _MIX[1]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * _MIX[2]).min(axis=1))
    return (least[::2] ^ (least[1::2] >> np.uint64(7))) * _MIX[2, :BANDS, 0] + np.arange(BANDS, dtype=np.uint64)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps, keys, sets = [], [], []
            for t in batch.column("text").to_pylist():
                hashes = shingle_hashes(t, shingle)
                own = np.unique(hashes)
                fps.append(simhash(hashes) if len(hashes) else 0)
                keys.append(band_keys(own).view(np.int64) if len(own) else [])
                sets.append(np.unique(own.astype(np.uint32)).tobytes())
            arrays = [batch.column("rid"), batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "doc_id", "fp", "keys", "shingles"])

    return run


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """Fingerprint, bucket keys and set of 32-bit shingle hashes."""
    return texts.mapInArrow(_sketches(shingle), "rid bigint, doc_id bigint, fp bigint, keys array<bigint>, shingles binary")


class VantageTree:
    """The upper levels of the tree; heap-ordered nodes, leaves from 0."""

    def __init__(self, sample: np.ndarray, levels: int, seed: int = 7):
        self.levels = levels
        bit = np.arange(64)
        self.masks = [np.uint64(sum(1 << int(b) for b in bit[bit % levels == k])) for k in range(levels)] if levels else []
        self.vantages = np.zeros(max(1, (1 << levels) - 1), np.uint64)
        self.radii = np.zeros(len(self.vantages), np.int64)
        rng = np.random.default_rng(seed)
        node = np.zeros(len(sample), np.int64)
        for k, mask in enumerate(self.masks):
            first, width = (1 << k) - 1, int(mask).bit_count()
            order = np.argsort(node, kind="stable")
            cuts = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
            for i in range(first + 1):
                own = sample[order[cuts[i] : cuts[i + 1]]]
                if len(own):
                    self.vantages[first + i] = v = own[rng.integers(len(own))]
                    far = np.bincount(np.bitwise_count((own ^ v) & mask), minlength=width + 1).cumsum()
                    self.radii[first + i] = min(width - 1, int(np.abs(far * 2 - len(own)).argmin()))
                else:
                    self.radii[first + i] = width // 2
            node = self._step(sample, node, mask)

    def _step(self, x: np.ndarray, node: np.ndarray, mask: np.uint64) -> np.ndarray:
        return 2 * node + 1 + (np.bitwise_count((x ^ self.vantages[node]) & mask) > self.radii[node])

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for mask in self.masks:
            node = self._step(x, node, mask)
        return node - ((1 << self.levels) - 1)

    def visits(self, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that may hold something within distance."""
        row, node, left = np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), distance)
        for mask in self.masks:
            d = np.bitwise_count((x[row] ^ self.vantages[node]) & mask).astype(np.int64)
            over = d - self.radii[node]  # at most 0: inside
            inner, outer = left - np.maximum(over, 0), left - np.maximum(1 - over, 0)
            a, b = inner >= 0, outer >= 0
            row, node, left = np.r_[row[a], row[b]], np.r_[2 * node[a] + 1, 2 * node[b] + 2], np.r_[inner[a], outer[b]]
        return row, node - ((1 << self.levels) - 1)


def _deal(tree: VantageTree, distance: int):
    """Rows (leaf, fp, home): each fingerprint in its own shard, and in the
    later shards that it has to be looked for in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            home = tree.home(x)
            row, leaf = tree.visits(x, distance)
            keep = leaf >= home[row]
            row, leaf = row[keep], leaf[keep]
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(x[row].view(np.int64)), pa.array(leaf == home[row])], ["leaf", "fp", "home"])

    return run


def close_links(members: np.ndarray, others: np.ndarray, distance: int, among: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among members (unless they are compared
    elsewhere), and of others to members.

    Members and others hold each value once and share none."""
    x = np.concatenate([members, others])
    root = np.arange(len(x))
    links: list[tuple[int, int]] = []
    step = max(1, (1 << 21) // max(1, len(members)))
    for at in range(0 if among else len(members), len(x), step):
        near = np.bitwise_count(x[at : at + step, None] ^ members[None, :]) <= distance
        for i in np.nonzero(near.sum(axis=1) > 1)[0] if at + step <= len(members) else np.nonzero(near.any(axis=1))[0]:
            found = np.unique(root[np.nonzero(near[i])[0]])
            here = root[at + i]
            for r in found[found != here]:
                links.append((at + i, int(r)))
                low, high = min(root[at + i], r), max(root[at + i], r)
                root[root == high] = low
    a, b = (np.array([p[k] for p in links], np.int64) for k in (0, 1))
    return x[a], x[b]


def _sides(x: np.ndarray, home: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """What a tile has to compare: members, others, and whether the members
    among themselves. A tile of two pieces leaves out what is inside of each."""
    for one, two, among in ((low, low, True),) if low.all() else ((low, ~low, False), (~low, low & ~home, False)):
        members = np.unique(x[one & home])
        others = np.setdiff1d(x[two & ~home] if among else x[two], members)
        if len(members):
            yield members, others, among


def _compare(distance: int):
    def run(group: pa.Table) -> pa.Table:
        x, home, low = (group.column(c).to_numpy() for c in ("fp", "home", "low"))
        found = [close_links(members, others, distance, among) for members, others, among in _sides(x.view(np.uint64), home, low)]
        a, b = (np.concatenate([np.zeros(0, np.uint64), *(f[k].astype(np.uint64) for f in found)]) for k in (0, 1))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def shards(fps: DataFrame, n: int, distance: int) -> DataFrame:
    """(leaf, fp, home, pieces): the ``n`` distinct ``fp`` in the shards of the
    tree that they have to be compared in, to find all within distance."""
    levels = min(MOST_LEVELS, max(0, math.ceil(math.log2(max(1, n) / LEAF))))
    share = min(1 << 31, int(SAMPLE / max(1, n) * (1 << 31)))
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 31)) < share).select("fp").toArrow()["fp"].to_numpy() if levels else np.zeros(0, np.int64)
    tree = VantageTree(np.sort(sample).view(np.uint64), levels)
    dealt = fps.select("fp").mapInArrow(_deal(tree, distance), "leaf bigint, fp bigint, home boolean")
    # a row for each shard that is too large, of which there are 2**levels at the most
    large = fps.select("fp").mapInArrow(_homes(tree), "leaf bigint").groupBy("leaf").count().where(F.col("count") > PIECE)
    return dealt.join(F.broadcast(large), "leaf", "left").withColumn("pieces", F.ceil(F.coalesce("count", F.lit(1)) / PIECE)).drop("count")


def links(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that join all of the ``n`` distinct ``fp`` within distance,
    directly or through others."""
    return _tiled(shards(fps, n, distance)).groupBy("leaf", "lo", "hi").applyInArrow(_compare(distance), "a bigint, b bigint")


def _tiled(rows: DataFrame) -> DataFrame:
    """Cut each leaf into its number of ``pieces``: a row goes to the tiles
    (lo, hi) of its own piece with each piece; ``low`` if its own is ``lo``."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    tiled = own.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces").cast("int") - 1)).alias("other"))
    tiled = tiled.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("low"))
    return tiled.drop("own", "other", "pieces")


def _homes(tree: VantageTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.home(batch.column("fp").to_numpy().view(np.uint64)))], ["leaf"])

    return run


def near_pairs(members: np.ndarray, others: np.ndarray, distance: int, among: bool = True, nearest: int = NEAREST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a shard or a bucket: of each value the nearest members
    within distance, and the first."""
    x = np.concatenate([members, others])
    step = max(1, (1 << 21) // max(1, len(members)))
    for at in range(0 if among else len(members), len(x), step):
        apart = np.bitwise_count(x[at : at + step, None] ^ members[None, :])
        own = np.arange(at, min(at + step, len(members)))
        apart[own - at, own] = 65
        most, hit = min(nearest, len(members)), np.flatnonzero((apart <= distance).any(axis=1))
        if not len(hit):
            continue
        apart = apart[hit]
        near = np.argpartition(apart, most - 1, axis=1)[:, :most]
        near = np.c_[near, (apart <= distance).argmax(axis=1)]
        row, k = np.nonzero(np.take_along_axis(apart, near, 1) <= distance)
        yield x[at + hit[row]], members[near[row, k]]


def _candidates(distance: int, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("x"):
                fp, low = (v.to_numpy(zero_copy_only=False) for v in group.values.flatten())
                for members, others, among in _sides(fp.view(np.uint64), np.ones(len(fp), bool), low):
                    for a, b in near_pairs(members, others, distance, among, nearest):
                        a, b = a.view(np.int64), b.view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return run


def _shard_candidates(distance: int, nearest: int):
    def run(group: pa.Table) -> pa.Table:
        x, home, low = (group.column(c).to_numpy() for c in ("fp", "home", "low"))
        found = [pair for members, others, among in _sides(x.view(np.uint64), home, low) for pair in near_pairs(members, others, distance, among, nearest)]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k].view(np.int64) for f in found)]) for k in (0, 1))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _confirm(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [jaccard(x.as_py(), y.as_py()) >= similar for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return run


def _among(asked):
    """The rows whose fingerprint a bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(asked.value, batch.column("fp").to_numpy().view(np.uint64))))

    return run


def _parted(distance: int, similar: float):
    """Rows (leaf, fp) of a tile that are within distance of one of another
    component whose set is of a size that ``similar`` allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, group in zip(batch.column("leaf").to_pylist(), batch.column("x"), strict=True):
                fp, label, size, low = (v.to_numpy(zero_copy_only=False) for v in group.values.flatten())
                if (label == label[0]).all():
                    continue
                one, two = np.nonzero(low)[0], np.arange(len(fp)) if low.all() else np.nonzero(~low)[0]
                step, parted, x = max(1, (1 << 21) // max(1, len(two))), np.zeros(len(fp), bool), fp.view(np.uint64)
                for at in range(0, len(one), step):
                    i = one[at : at + step, None]
                    met = (label[i] != label[two]) & (np.bitwise_count(x[i] ^ x[two]) <= distance)
                    met &= np.minimum(size[i], size[two]) >= similar * np.maximum(size[i], size[two])
                    parted[one[at : at + step]] |= met.any(axis=1)
                    parted[two] |= met.any(axis=0)
                found = fp[parted]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), leaf)), pa.array(found)], ["leaf", "fp"])

    return run


def set_links(x: np.ndarray, label: np.ndarray, sets: list[np.ndarray], low: np.ndarray, distance: int, similar: float) -> list[tuple[int, int]]:
    """A spanning forest, over components, of the links between rows: those
    marked ``low`` with the others, or among themselves if all are."""
    one, two = np.nonzero(low)[0], np.arange(len(x)) if low.all() else np.nonzero(~low)[0]
    if not len(one) or not len(two):
        return []
    sizes = np.array([len(v) for v in sets])
    owners, values = np.repeat(np.arange(len(two)), sizes[two]), np.concatenate([sets[i] for i in two])
    order = np.argsort(values, kind="stable")
    owners, values = owners[order], values[order]
    root = np.unique(label, return_inverse=True)[1]
    found, step = [], max(1, (1 << 21) // len(two))
    for i in one:
        asked = (root[two] != root[i]) & (np.bitwise_count(x[two] ^ x[i]) <= distance)
        if not asked.any():
            continue
        both = np.zeros(len(two), np.int64)
        for at in range(0, sizes[i], step):  # a value is in each set once at the most
            part = sets[i][at : at + step]
            first, last = np.searchsorted(values, part, "left"), np.searchsorted(values, part, "right")
            n = last - first
            both += np.bincount(owners[np.repeat(first - (n.cumsum() - n), n) + np.arange(n.sum())], minlength=len(two))
        for k in np.nonzero(asked & (both >= similar * (sizes[two] + sizes[i] - both)))[0]:
            j = two[k]
            if root[i] != root[j]:
                found.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return found


def _compare_sets(distance: int, similar: float):
    def run(group: pa.Table) -> pa.Table:
        fp, label, low = (group.column(c).to_numpy() for c in ("fp", "label", "low"))
        sets = [np.frombuffer(v.as_py(), np.uint32) for v in group.column("set")]
        found = np.array(set_links(fp.view(np.uint64), label, sets, low, distance, similar), np.int64).reshape(-1, 2)
        return pa.table({"a": fp[found[:, 0]], "b": fp[found[:, 1]]})

    return run


def _tile_lists(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("leaf", "lo", "hi").agg(F.collect_list(F.struct(*columns, "low")).alias("x"))


def similar_links(rows: DataFrame, tree: DataFrame, distance: int, similar: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) of ``sketches`` whose sets of shingles have at least the
    Jaccard similarity ``similar``: of each, those to its nearest in the shards
    ``tree``, within ``REACH``, and in a bucket, within distance. With them the
    buckets and the sets, for ``rest_links``."""
    dealt = Stored(rows.select("fp", F.explode("keys").alias("leaf")).distinct(), "bucket-keys")
    sizes = dealt.df.groupBy("leaf").count().where("count > 1")
    shared = Stored(join_counted(dealt.df, sizes, ["leaf"], "count", dealt.df.count()).withColumn("pieces", F.ceil(F.col("count") / PIECE)), "buckets").df
    dealt.drop()
    release(rows.sparkSession)
    groups = _tile_lists(_tiled(shared), "fp").select("x")
    near = _tiled(tree).groupBy("leaf", "lo", "hi").applyInArrow(_shard_candidates(min(REACH, distance), NEAREST), "a bigint, b bigint")
    pairs = Stored(near.union(groups.mapInArrow(_candidates(distance, NEAREST), "a bigint, b bigint")).distinct(), "candidates").df
    release(rows.sparkSession)
    # of a large bucket all pair with the first, so that its set is asked for often
    wanted = Stored(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "wanted").df
    asked = bitmap(wanted.select(F.col("fp").alias("h")), wanted.count())
    own = rows.select("fp", "shingles").mapInArrow(_among(asked), "fp bigint, shingles binary")  # sets that nobody asks for aren't shuffled
    sets = Stored(own.groupBy("fp").agg(F.min("shingles").alias("set")).join(wanted, "fp"), "shingle-sets").df
    release(rows.sparkSession)
    n, met = 2 * pairs.count(), pairs
    for own, name in (("a", "x"), ("b", "y")):
        met = join_counted(met, sets.select(F.col("fp").alias(own), F.col("set").alias(name), F.col("n").alias(f"n{own}")), [own], f"n{own}", n, most=256)
    return met.select("a", "b", "x", "y").mapInArrow(_confirm(similar), "a bigint, b bigint"), shared, sets


def rest_links(shared: DataFrame, sets: DataFrame, labels: DataFrame, distance: int, similar: float) -> DataFrame | None:
    """Links between the components ``labels`` (node, label) that nearest
    neighbours missed in shards or buckets (leaf, fp, pieces), or None. A
    fingerprint is in ``BANDS`` buckets at the most, and in some shards, so that
    no join here has a hot key but that by bucket."""
    facts = sets.join(labels, sets["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"), F.length("set").alias("size"))
    named = shared.select("leaf", "fp", "pieces").join(facts, "fp")
    parted = _tile_lists(_tiled(named), "fp", "label", "size").mapInArrow(_parted(distance, similar), "leaf bigint, fp bigint").distinct()
    parted = Stored(parted.join(facts, "fp"), "parted")
    n = parted.df.count()
    if not n:
        parted.drop()
        return None
    sizes = parted.df.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / PIECE_BYTES).alias("pieces"))
    asked = join_counted(parted.df, sizes, ["leaf"], "n", n).join(sets.select("fp", "set"), "fp")
    return _tiled(asked.select("leaf", "fp", "label", "set", "pieces")).groupBy("leaf", "lo", "hi").applyInArrow(_compare_sets(distance, similar), "a bigint, b bigint")


def _similar_components(rows: DataFrame, fps: DataFrame, n: int, distance: int, similar: float) -> DataFrame:
    reach = min(REACH, distance)
    tree = Stored(shards(fps, n, reach), "shards").df
    found, shared, sets = similar_links(rows, tree, distance, similar)
    labels = components(found)
    # where a bucket has at most NEAREST others, all pairs have been compared
    rest = [rest_links(tree, sets, labels, reach, similar), rest_links(shared.where(F.col("count") > NEAREST + 1), sets, labels, distance, similar)]
    rest = [x for x in rest if x is not None]
    if not rest:
        return labels
    return components(reduce(DataFrame.union, rest, labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def _assigned(texts: DataFrame, distance: int, shingle: int, similar: float | None) -> DataFrame:
    """Of rows (rid, doc_id, text): rid, doc_id, fp, and of the row's component
    component_id, the number of its rows, and ``first``, the row number of its
    least id."""
    rows = Stored(fingerprints(texts, shingle) if similar is None else sketches(texts, shingle), "fingerprints").df
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    firsts = Stored(rows.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints-distinct").df
    n = firsts.count()
    labels = components(links(firsts, n, distance)) if similar is None else _similar_components(rows, firsts, n, distance, similar)
    named = firsts.join(labels, firsts["fp"] == labels["node"], "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("least"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("fps"))
    of = join_counted(named.select("fp", "n", "label"), least, ["label"], "fps", n).select("fp", "n", "size", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("first"))
    of = Stored(of, "components").df
    release(texts.sparkSession)
    return join_counted(rows.select("rid", "doc_id", "fp"), of, ["fp"], "n", rows.count())


def components_of(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, similar: float | None = None) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    return _assigned(_texts(docs, F.monotonically_increasing_id()), distance, shingle, similar).select("doc_id", "fp", "component_id")


def report(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    return components_of(docs, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, similar: float | None = None) -> DataFrame:
    """One row of each component, the one of the least id, null last, with all
    its columns. Texts are not shuffled while the rows that go are few."""
    kept = with_rid(docs, "near-rows")
    rows, others = kept.df, {x.path for x in Stored.kept}
    found = _assigned(_texts(rows.select("rid", "row.doc_id", "row.text"), F.col("rid")), distance, shingle, similar)
    copies = Stored(found.where((F.col("size") > 1) & (F.col("rid") != F.col("first"))).select("rid"), "near-copies")
    drop_stored(others | {copies.path})
    release(docs.sparkSession)
    gone = copies.df
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, "rid", "left_anti").select("row.*")
