"""Exact substring dedup by prefix-free parsing.

Each text is cut at triggers chosen by a rolling hash: the least of the
``window - trigger + 1`` hashes of ``trigger`` bytes in each window of
``window`` bytes. Consecutive windows with one trigger form a phrase, so
phrases overlap by window - 1 bytes, every window lies in one phrase, and
which one depends on the window's bytes alone. The parse is the sequence of
phrases; the dictionary is the set of distinct ones. A window can occur twice
only under a trigger that occurs twice, so:

1. the triggers of the parse are counted (one small row for each phrase, about
   a fortieth of the bytes): most occur once and end here;
2. the parse is ordered: occurrences of phrases under repeated triggers are
   brought together by phrase and, within a phrase, in corpus order. All but
   the first are repeats as a whole, and the firsts are the dictionary;
3. the dictionary is ordered: of the phrases under one trigger, the suffixes
   from the trigger on are sorted by their bytes, and so are the prefixes
   before it, read backwards, both with the lengths of the common prefixes of
   neighbours (a suffix array each). Windows that are equal have the trigger at
   the same place, so the window with ``a`` bytes before the trigger has, in
   the two orders, a class at the depths a and window - a: two windows are
   equal if both classes are. All but the first in corpus order are repeats;
4. repeats become byte runs of their rows, which are cut out.

So windows are compared by their bytes. Phrases are told apart by 128 bits of
two rolling hashes with different tables, and their trigger's hash. A trigger
with more than ``MOST_PHRASES`` phrases is no group of one task. A window holds
half of its other bytes before the trigger, or more than the other half after
it: its phrases are cut into two that share a window - 1 bytes at most, one
grouped by the half before and one by the half after; all but the first of
equal parts are repeats as a whole. Of groups that are still too large the
windows become rows, told apart like phrases, and the least place
of each is combined before it is shuffled. Phrases and windows that a large
share of the rows have are joined by broadcast. Which triggers to look at
travels to the next pass over the texts as bitmaps of bounded size, which may
let too much through but never too little.

What is shuffled is bounded: phrases are brought together, and the dictionary
is ordered, in rounds by hash, each with its own part of the keys and all rows
of it, and what a round has shuffled is freed before the next.

Defined results: a null text counts as empty; matches never cross documents;
documents come in order of id, null first, and rows of one id, or of none, in
the order in which they are stored, each a document of its own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, bitmap, join_counted, marked, release, slices

WINDOW = 100
TRIGGER = 20
#: Bytes parsed at once; longer texts are parsed in pieces that overlap.
CHUNK = 1 << 18
#: Phrases of one trigger that one task orders; more are dealt out as rows.
MOST_PHRASES = 2000
#: Phrases of the dictionary that a task orders, on average.
TASK_PHRASES = 200_000
#: Phrases, and phrases of the dictionary, that a round shuffles: some 1 GB
#: each. From ``MOST_ROUNDS`` on rounds grow instead.
ROUND_PHRASES = 1 << 25
ROUND_ENTRIES = 1 << 23
MOST_ROUNDS = 16
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xD6E8FEB86659FD93
_TABLE2 = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _join(a: np.ndarray, b: np.ndarray, shift: int, n: int) -> np.ndarray:
    """Hashes of runs made of a run of ``shift`` bytes and one of ``n``."""
    return a[: len(b) - shift] * _power(n) + b[shift:]


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the second base, and of its inverse, up to the n-th."""
    def of(base: int) -> np.ndarray:
        x = np.full(n + 1, base, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return of(_BASE2), of(pow(_BASE2, -1, 1 << 64))


class Runs:
    """Rolling hashes, of the second kind, of runs of any length."""

    def __init__(self, data: np.ndarray):
        powers, self.back = _powers(1 << (len(data) - 1).bit_length())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE2[data] * powers[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


class Parse:
    """Phrases of a chunk of bytes in which ``limits`` end the documents."""

    def __init__(self, data: np.ndarray, limits: np.ndarray, window: int = WINDOW, trigger: int = TRIGGER):
        n_windows = len(data) - window + 1
        if n_windows <= 0:
            self.start = self.count = self.left = np.zeros(0, np.int64)
            self.trigger = self.key = self.hashes = np.zeros(0, np.uint64)
            return
        runs = {1: _TABLE[data]}
        n = 1
        while n * 2 <= window:
            runs[n * 2] = _join(runs[n], runs[n], n, n)
            n *= 2

        def of(length: int) -> np.ndarray:
            done, out = 0, None
            for b in sorted(runs, reverse=True):
                if length & b:
                    out = runs[b] if out is None else _join(out, runs[b], done, b)
                    done += b
            return out

        short = _mix(of(trigger))
        self.hashes = _mix(of(window))
        least = (short & ~_PLACE) | np.arange(len(short), dtype=np.uint64)
        span, n = window - trigger + 1, 1
        while n * 2 <= span:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if span > n:
            least = np.minimum(least[: len(least) - (span - n)], least[span - n :])
        place = (least & _PLACE).astype(np.int64)
        # windows that lie in one document
        doc_end = np.repeat(limits, np.diff(np.r_[0, limits]))[:n_windows]
        whole = np.arange(n_windows) + window <= doc_end
        first = whole & np.r_[True, (place[1:] != place[:-1]) | ~whole[:-1]]
        self.start = np.flatnonzero(first)
        ends = np.flatnonzero(whole & np.r_[(place[1:] != place[:-1]) | ~whole[1:], True])
        self.count = ends - self.start + 1
        at = place[self.start]
        self.left = at - self.start  # bytes before the trigger
        self.trigger = short[at]
        shape = (at - self.start).astype(np.uint64) * np.uint64(1024) + self.count.astype(np.uint64)
        self.key = _mix(self.hashes[self.start] * np.uint64(3) + _mix(self.hashes[ends] + shape))


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
    """(bytes, document ends, rows, starts within the document) of each chunk;
    a row is its number and its id."""
    data, ends, ids, starts, size = [], [], [], [], 0
    for batch in slices(batches, "text"):
        for key in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
            *key, text = key
            raw = (text or "").encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(raw) - window + 1), CHUNK):
                part = raw[at : at + CHUNK + window - 1]
                if len(part) < window:
                    continue
                data.append(part)
                size += len(part)
                ends.append(size)
                ids.append(key)
                starts.append(at)
                if size >= CHUNK:
                    yield np.frombuffer(b"".join(data), np.uint8), np.array(ends), ids, starts
                    data, ends, ids, starts, size = [], [], [], [], 0
    if data:
        yield np.frombuffer(b"".join(data), np.uint8), np.array(ends), ids, starts


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _triggers(window: int, trigger: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, ends, _, _ in _chunks(batches, window):
            yield pa.RecordBatch.from_arrays([_long(Parse(data, ends, window, trigger).trigger)], ["t"])

    return run


def _places(which: np.ndarray, p: Parse, ends: np.ndarray, rows: list, starts: list) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Id, row number and start within the document of the phrases in ``which``."""
    at = p.start[which]
    doc = np.searchsorted(ends, at, side="right")
    begin = np.r_[0, ends[:-1]][doc]
    rid, ids = (pa.array([r[i] for r in rows], pa.int64()).take(pa.array(doc)) for i in (0, 1))
    return ids, rid, np.array(starts, np.int64)[doc] + at - begin


PHRASES = "k bigint, k2 bigint, t bigint, doc_id bigint, rid bigint, start bigint, count bigint"
KEY = ["k", "k2", "t"]


def _phrases(window: int, trigger: int, repeated):
    """Occurrences of phrases under repeated triggers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, ends, rows, starts in _chunks(batches, window):
            p = Parse(data, ends, window, trigger)
            which = np.flatnonzero(marked(repeated.value, p.trigger))
            doc, rid, start = _places(which, p, ends, rows, starts)
            begin, count = p.start[which], p.count[which].astype(np.int64)
            k2 = Runs(data).of(begin, begin + count + (window - 1))
            yield pa.RecordBatch.from_arrays([_long(p.key[which]), _long(k2), _long(p.trigger[which]), doc, rid, pa.array(start), pa.array(count)], ["k", "k2", "t", "doc_id", "rid", "start", "count"])

    return run


def _place_hash(k: np.ndarray, rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """As in ``_PLACE_HASH``."""
    rid, start = rid.astype(np.int64).view(np.uint64), start.astype(np.int64).view(np.uint64)
    return k ^ rid ^ (rid << np.uint64(13)) ^ (start << np.uint64(5))


_PLACE_HASH = "k ^ rid ^ shiftleft(rid, 13) ^ shiftleft(start, 5)"


PART = ["g", "left", "body"]
ENTRIES = "g bigint, doc_id bigint, rid bigint, start bigint, left int, body binary, crowd boolean"


def _halves(p: Parse, which: np.ndarray, data: np.ndarray, window: int, trigger: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The two parts of the phrases ``which``: (index in which, first window,
    number of windows, group). Windows with ``half`` bytes or more before the
    trigger are in the first, all others in the second."""
    half, runs, at = (window - trigger + 1) // 2, Runs(data), p.start[which] + p.left[which]
    left, count = p.left[which], p.count[which].astype(np.int64)
    one = np.flatnonzero(left >= half)
    yield one, np.zeros(len(one), np.int64), np.minimum(count, left - half + 1)[one], _mix(runs.of(at[one] - half, at[one] + trigger) ^ p.trigger[which[one]])
    off = np.maximum(0, left - half + 1)
    two = np.flatnonzero(count > off)
    yield two, off[two], (count - off)[two], _mix(~runs.of(at[two], at[two] + window - half + 1) ^ p.trigger[which[two]])


def _dictionary(window: int, trigger: int, firsts, several, crowded):
    """Phrases of the dictionary that are to be ordered, with their group, their
    bytes and the place of the trigger in them; in two parts each under a
    crowded trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, ends, rows, starts in _chunks(batches, window):
            p = Parse(data, ends, window, trigger)
            which = np.flatnonzero(marked(several.value, p.trigger))
            doc, rid, start = _places(which, p, ends, rows, starts)
            ok = np.flatnonzero(marked(firsts.value, _place_hash(p.key[which], rid.to_numpy(), start)))
            which, doc, rid, start = which[ok], doc.take(pa.array(ok)), rid.take(pa.array(ok)), start[ok]
            many = marked(crowded.value, p.trigger[which])
            few, crowd = np.flatnonzero(~many), np.flatnonzero(many)
            parts = [(few, np.zeros(len(few), np.int64), p.count[which[few]], p.trigger[which[few]])]
            if len(crowd):
                parts += [(crowd[of], off, n, g) for of, off, n, g in _halves(p, which[crowd], data, window, trigger)]
            raw = data.tobytes()
            for k, (of, off, n, g) in enumerate(parts):
                body = [raw[a : a + m + window - 1] for a, m in zip((p.start[which[of]] + off).tolist(), n.tolist(), strict=True)]
                left = pa.array((p.left[which[of]] - off).astype(np.int32))
                arrays = [_long(g), doc.take(pa.array(of)), rid.take(pa.array(of)), pa.array(start[of] + off), left, pa.array(body, pa.binary()), pa.array(np.full(len(of), k > 0))]
                yield pa.RecordBatch.from_arrays(arrays, ["g", "doc_id", "rid", "start", "left", "body", "crowd"])

    return run


WINDOWS = "k bigint, k2 bigint, t bigint, doc_id bigint, rid bigint, start bigint"


def _windows(window: int, trigger: int):
    """A row for each window of phrases of the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", CHUNK):
            if not batch.num_rows:
                continue
            body = batch.column("body").to_pylist()
            data, ends = np.frombuffer(b"".join(body), np.uint8), np.cumsum([len(b) for b in body])
            n = np.diff(np.r_[0, ends]) - window + 1
            of = np.repeat(np.arange(len(body)), n)
            off = np.arange(n.sum()) - np.repeat(np.r_[0, n.cumsum()[:-1]], n)
            at = np.r_[0, ends[:-1]][of] + off
            t, doc, rid = (batch.column(c).take(pa.array(of)) for c in ("g", "doc_id", "rid"))
            start = batch.column("start").to_numpy()[of] + off
            arrays = [_long(Parse(data, ends, window, trigger).hashes[at]), _long(Runs(data).of(at, at + window)), t, doc, rid, pa.array(start)]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "k2", "t", "doc_id", "rid", "start"])

    return run


def suffix_array(context: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of ``context`` by group and then by their bytes,
    and how many bytes each has in common with the one before it in that
    order; -1 where a group begins."""
    m, width = context.shape
    key = np.empty((m, width + 8), np.uint8)
    key[:, :8] = group.astype(">u8").view(np.uint8).reshape(m, 8)
    key[:, 8:] = context
    order = np.argsort(key.view(f"S{width + 8}").reshape(m), kind="stable")
    sorted_, own = context[order], group[order]
    differs = np.ones((max(0, m - 1), width + 1), bool)  # the last column ends the search
    np.not_equal(sorted_[1:], sorted_[:-1], out=differs[:, :width])
    common = np.r_[-1, np.where(own[1:] == own[:-1], differs.argmax(axis=1), -1)] if m else np.zeros(0, np.int64)
    return order, common


def repeated_windows(bodies: list[bytes], left: np.ndarray, group: np.ndarray, window: int, trigger: int) -> tuple[np.ndarray, np.ndarray]:
    """Of phrases in corpus order, with ``left`` bytes before their trigger and
    a number for each trigger: the phrase and the place of every window that an
    earlier phrase of the group has too."""
    most, m = window - trigger, len(bodies)
    size, pad = np.array([len(b) for b in bodies]), bytes(most)
    frame = np.frombuffer(b"".join([(pad[n:] + b).ljust(most + window, b"\0") for b, n in zip(bodies, left.tolist(), strict=True)]), np.uint8).reshape(m, most + window)
    after, before = suffix_array(np.ascontiguousarray(frame[:, most:]), group), suffix_array(np.ascontiguousarray(frame[:, :most][:, ::-1]), group)
    right = size - left

    def classes(ordered: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
        out = np.empty(m, np.int64)
        out[ordered[0]] = np.cumsum(ordered[1] < depth)
        return out

    phrases, places = [], []
    for a in range(most + 1):
        own = np.flatnonzero((left >= a) & (right >= window - a))
        if len(own) > 1:
            key = (classes(before, a) * (m + 1) + classes(after, window - a))[own]
            order = np.argsort(key, kind="stable")  # stable: corpus order among equals
            again = own[order[1:][key[order[1:]] == key[order[:-1]]]]
            phrases.append(again)
            places.append(left[again] - a)
    if not phrases:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    phrase, place = np.concatenate(phrases), np.concatenate(places)
    order = np.lexsort((place, phrase))
    return phrase[order], place[order]


def _order(window: int, trigger: int):
    """Repeated windows among phrases that come sorted by group."""

    def repeated(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("doc_id", "ascending"), ("rid", "ascending"), ("start", "ascending")])  # nulls come last here: first below
        doc = rows["doc_id"].combine_chunks()
        rows = rows.take(pa.array(np.argsort(doc.is_valid().to_numpy(zero_copy_only=False), kind="stable")))
        group = np.unique(rows["g"].to_numpy(), return_inverse=True)[1]
        of, at = repeated_windows(rows["body"].to_pylist(), rows["left"].to_numpy().astype(np.int64), group, window, trigger)
        new = np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)][: len(of)]
        last = np.r_[new[1:], True][: len(of)]
        start = rows["start"].to_numpy()[of]
        return pa.RecordBatch.from_arrays([rows["rid"].combine_chunks().take(pa.array(of[new])), pa.array((start + at)[new]), pa.array((start + at)[last] + window)], ["rid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > (8 << 20):
                rows = pa.Table.from_batches(held)
                g = rows["g"].to_numpy()
                cut = int(np.searchsorted(g, g[-1], side="left"))  # the last group may go on
                if cut:
                    yield repeated(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield repeated(pa.Table.from_batches(held))

    return run


def _later(rows: DataFrame, firsts: DataFrame, total: int, length: Column, keys: list[str] = KEY) -> DataFrame:
    """The rows that stand later than the first of their key, as byte runs."""
    met = join_counted(rows, firsts.select(*keys, "m", "first"), keys, "m", total).where(F.struct("doc_id", "rid", "start") > F.col("first"))
    return met.select("rid", "start", (F.col("start") + length).alias("end"))


def _rounds(key: str, n: int, most: int) -> list[Column]:
    """Conditions on a hash, one for each round, that ``n`` rows are dealt by."""
    rounds = min(MOST_ROUNDS, max(1, -(-n // most)))
    return [F.pmod(F.shiftrightunsigned(key, 32), F.lit(rounds)) == k if rounds > 1 else F.lit(True) for k in range(rounds)]


def _union(tables: list[Stored]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.df for x in tables])


def stored_texts(docs: DataFrame) -> Stored:
    """rid, doc_id and text of every row."""
    return Stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "dedup-texts")


def repeats(texts: DataFrame, window: int = WINDOW, trigger: int = TRIGGER) -> Stored:
    """(rid, runs): the byte runs (a, b) made of repeated windows, of each row
    of ``stored_texts`` that has any; they may overlap."""
    spark = texts.sparkSession
    one, place = F.count(F.lit(1)).alias("m"), F.struct("doc_id", "rid", "start")
    counted = texts.select("rid", "doc_id", "text").mapInArrow(_triggers(window, trigger), "t bigint").groupBy("t").agg(one)
    again = Stored(counted.where("m > 1").select(F.col("t").alias("h")), "triggers")
    repeated = bitmap(again.df, again.df.count())
    again.drop()
    release(spark)

    phrases = Stored(texts.mapInArrow(_phrases(window, trigger, repeated), PHRASES), "phrases")
    firsts, found, n = [], [], phrases.df.count()
    rounds = _rounds("k", n, ROUND_PHRASES)
    for part in rounds:
        own = phrases.df.where(part)
        firsts.append(Stored(own.groupBy(*KEY).agg(one, F.min(place).alias("first")), "phrase-firsts"))
        release(spark)
        found.append(Stored(_later(own, firsts[-1].df.where("m > 1"), n // len(rounds), F.col("count") + (window - 1)), "phrase-runs"))
        release(spark)
    phrases.drop()
    first = _union(firsts)
    several = Stored(first.groupBy("t").agg(F.count(F.lit(1)).alias("phrases")).where("phrases > 1"), "triggers-several")
    triggers, entries = several.df.agg(F.count(F.lit(1)), F.coalesce(F.sum("phrases"), F.lit(0))).first()
    told = bitmap(several.df.select(F.col("t").alias("h")), triggers)
    asked_for = join_counted(first, several.df, ["t"], "phrases", first.count())
    asked = bitmap(asked_for.select("k", "first.rid", "first.start").select(F.expr(_PLACE_HASH).alias("h")), entries)
    crowd = several.df.where(F.col("phrases") > MOST_PHRASES).select(F.col("t").alias("h"))
    crowded = bitmap(crowd, 256 * crowd.count())  # what it lets through in error costs rows
    for done in (several, *firsts):
        done.drop()
    release(spark)
    dictionary = Stored(texts.mapInArrow(_dictionary(window, trigger, asked, told, crowded), ENTRIES), "dictionary")
    halves, n = dictionary.df.where("crowd"), dictionary.df.count()
    parts = Stored(halves.groupBy(*PART).agg(one, F.min(place).alias("first")), "crowd-parts")
    large = Stored(parts.df.groupBy("g").agg(F.count(F.lit(1)).alias("phrases")).where(F.col("phrases") > MOST_PHRASES).select("g"), "groups-crowded")
    some = large.df.count() > 0  # at most n / MOST_PHRASES
    if parts.df.count():
        found.append(Stored(_later(halves, parts.df.where("m > 1"), halves.count(), F.length("body"), PART), "crowd-runs"))
    release(spark)

    columns = ["g", "doc_id", "rid", "start", "left", "body"]
    entries = dictionary.df.where("not crowd").select(*columns).unionByName(parts.df.select("g", "first.*", "left", "body"))
    rounds = _rounds("g", n, ROUND_ENTRIES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // len(rounds) // TASK_PHRASES)
    kept, last = [*found], []
    for part in rounds:
        own = entries.where(part)
        few = own.join(F.broadcast(large.df), "g", "left_anti") if some else own
        last = [few.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(_order(window, trigger), "rid bigint, start bigint, end bigint")]
        if some:
            rows = Stored(own.join(F.broadcast(large.df), "g").drop("left").mapInArrow(_windows(window, trigger), WINDOWS), "crowd-windows")
            kept.append(rows)
            crowd_firsts = rows.df.groupBy(*KEY).agg(one, F.min(place).alias("first")).where("m > 1")
            last.append(_later(rows.df, crowd_firsts, rows.df.count(), F.lit(window)))
        if len(rounds) > 1:
            found.append(Stored(reduce(DataFrame.unionByName, last), "window-runs"))
            kept, last = [*kept, found[-1]], []
            release(spark)
    runs = Stored(reduce(DataFrame.unionByName, [_union(found), *last]).groupBy("rid").agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).alias("runs")), "byte-runs")
    for done in (dictionary, parts, large, *kept):
        done.drop()
    for bits in (repeated, asked, told, crowded):
        bits.destroy()
    release(spark)
    return runs


def _merge_starts(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]


def _cut(raw: bytes, runs) -> tuple[bytes, int]:
    if not runs or not len(runs):
        return raw, 0
    a, b = _merge_starts(np.array([r["a"] for r in runs]), np.array([r["b"] for r in runs]))
    keep, at = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        keep.append(raw[at:x])
        at = y
    return b"".join([*keep, raw[at:]]), len(a)


def _told(batch: pa.RecordBatch, runs: list) -> pa.RecordBatch:
    out = []
    for text, own in zip(batch.column("text").to_pylist(), runs, strict=True):
        raw = (text or "").encode("utf-8", "surrogatepass")
        kept, spans = _cut(raw, own)
        out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    cols = list(zip(*out, strict=True)) or [[]] * 4
    arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield _told(batch, batch.column("runs").to_pylist())


#: Row numbers, which are a partition and a place, as hashes for a bitmap.
_ROW_HASH = "rid ^ shiftleft(shiftright(rid, 33), 11)"


def _only(some, wanted: bool):
    """The documents that are in a bitmap of rows, or what is said of those that
    are not, in one pass, so that a task has one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rid = batch.column("rid").to_numpy().view(np.uint64)
            own = batch.filter(pa.array(marked(some.value, rid ^ ((rid >> np.uint64(33)) << np.uint64(11))) == wanted))
            yield own if wanted else _told(own, [None] * own.num_rows)

    return run


def report(docs: DataFrame, window: int = WINDOW, trigger: int = TRIGGER) -> DataFrame:
    """Per row: bytes, bytes removed, maximal runs removed, and the digest of
    what is left. Only rows with runs, as a bitmap tells roughly, send their
    texts through the join."""
    texts = stored_texts(docs).df
    runs = repeats(texts, window, trigger).df
    some = bitmap(runs.select(F.expr(_ROW_HASH).alias("h")), runs.count())
    met = texts.mapInArrow(_only(some, True), "rid bigint, doc_id bigint, text string").join(runs, "rid", "left")
    said = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return met.select("doc_id", "text", "runs").mapInArrow(_report, said).unionByName(texts.mapInArrow(_only(some, False), said))
