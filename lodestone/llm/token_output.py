"""Token output: ids at a fixed width of bits, in blocks with offsets.

Documents are dealt out by ranges of their key, sorted, encoded, and packed
into blocks. The file format is a Parquet table of blocks, written by Spark's
own committer to any file system that Spark reaches, one row a block:

* ``part``, ``block``    the place of the block in key order;
* ``bits``               width of an id: the least that holds the vocabulary;
* ``n``                  ids in the block;
* ``before``             ids in the earlier blocks of its part;
* ``doc_ids``, ``ends``  its whole documents and where each ends, in ids,
                         counted from the block's start;
* ``payload``            the ids, little end first: id i takes the bits from
                         i * bits on.

Any id is found by its block and its place: ``unpack(payload, bits, i, j)``
reads the ids i to j alone. A block's place in the whole output is ``before``
plus the ids of the earlier parts: one number a part.

Defined results: a null text counts as empty and has only the end id; rows of
one key are ordered by text, and each keeps a row; a null key comes first; an
empty table gives no blocks; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, slices

#: Rows of a part of the output, on average.
PART_ROWS = 100_000
#: Ids of a block, about 1 MB at 16 bits.
BLOCK_IDS = 1 << 19
#: Pieces whose ids a worker remembers, and bytes of those at the most.
CACHE_PIECES, LONG_PIECE = 600_000, 256
#: Bytes of text that are split together, one row at least.
TEXT_BYTES = 4 << 20
#: Characters whose classes no two Unicode versions or libraries disagree on,
#: and among them letters and numbers.
PLAIN = "\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = " \t\n\r"
#: How byte-level tokenizers split plain text before merging: the published
#: pattern. Files that say otherwise have their texts encoded whole.
PIECES = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"


def width(vocabulary: int) -> int:
    """The least bits that hold ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack ids below 2**bits; whole words are used where they fit exactly."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, end: int) -> np.ndarray:
    """The ids from ``start`` to ``end``, reading no other bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", end - start, start * (bits // 8)).astype(np.uint32)
    first, last = start * bits // 8, -(-end * bits // 8)
    raw = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    raw = raw[start * bits - first * 8 :][: (end - start) * bits].reshape(-1, bits)
    return (raw.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_chars() -> str:
    """The character that byte-level tokenizers write for each byte: itself, if
    it can be printed, or else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


BYTE_CHARS = _byte_chars()


def splits_as_known(file: dict) -> bool:
    """Whether a tokenizers file splits texts by the byte-level pattern, and
    neither changes them before nor merges over pieces after."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    return (
        file.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not file.get("truncation") and not file.get("padding")
        and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    )


def _classes() -> np.ndarray:
    """The class of each plain character; of all others, and beyond: ODD."""
    sets = (LETTERS, LETTER), (NUMBERS, NUMBER), (BLANKS, BLANK), (" ", SPACE)
    out = np.full(BEYOND + 1, ODD, np.uint8)
    for c in map(chr, range(BEYOND)):
        if re.match(f"[{PLAIN}]", c):
            out[ord(c)] = max((k for chars, k in sets if re.match(f"[{chars}]", c)), default=OTHER)
    return out


#: Classes that the split pattern tells apart; a space is a blank, too.
LETTER, NUMBER, OTHER, BLANK, SPACE, ODD = range(6)
#: The first character above all plain ones.
BEYOND = 0x250
CLASSES = _classes()


def piece_starts(chars: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where PIECES begins a piece in plain texts that stand one after another:
    code points and their classes; ``firsts``: where the texts start."""
    n = len(chars)
    first = np.zeros(n + 3, bool)
    first[firsts], first[n:] = True, True
    start, blank = first[:n].copy(), kinds >= BLANK
    start[1:] |= np.minimum(kinds[1:], BLANK) != np.minimum(kinds[:-1], BLANK)
    # of blanks before something else, the last is on its own, or if it is a space, begins what follows
    turn = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:n]) + 1
    start[turn - 1] = True
    start[turn[kinds[turn - 1] == SPACE]] = False
    # an apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it
    at = np.flatnonzero((chars == ord("'")) & start)
    at = at[~first[at + 1]]
    if len(at):
        one, two = chars[at + 1], np.where(first[at + 2], 0, chars[np.minimum(at + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[at[short | long] + 1] = False
        after = np.concatenate((at[short] + 2, at[long] + 3))
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Pieces(dict):
    """The ids of pieces, by their bytes, as the library's model merges them.

    When it is full, what it holds becomes ``old`` in place of what was that, so
    that pieces which keep coming are not forgotten."""

    def __init__(self, tokenize, most: int):
        self.tokenize, self.most, self.old = tokenize, most, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = _bytes([t.id for t in self.tokenize(piece.decode("latin-1").translate(BYTE_CHARS))])
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts with a tokenizers file, remembering the ids of pieces.

    A byte-level tokenizer merges within pieces of its split pattern only, so
    the ids of a text are those that the library's model gives its pieces.
    Texts with characters whose class could be told apart differently, or with
    a special token's string, go to the library whole; so do all texts where
    the file's own description of its split, read here, is not the byte-level
    one without a normalizer. The others are split together, and each distinct
    piece of theirs is looked up once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            self.by_pieces = splits_as_known(json.load(f))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known = Pieces(self.whole.model.tokenize, CACHE_PIECES // 2) if self.by_pieces else None

    def _ids(self, text: str) -> bytes:
        return _bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_pieces:
            return [self._ids(t) for t in texts]
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = CLASSES[np.minimum(chars, BEYOND)]
        ends = np.cumsum([len(t) for t in texts])
        apart = set(np.searchsorted(ends, np.flatnonzero(kinds == ODD), "right").tolist())
        for s in self.special:
            if s in joined:
                apart.update(i for i, t in enumerate(texts) if s in t)
        if apart:
            rest = iter(self.many([t for i, t in enumerate(texts) if i not in apart]))
            return [self._ids(t) if i in apart else next(rest) for i, t in enumerate(texts)]

        raw, at = joined.encode(), piece_starts(chars, kinds, np.append(0, ends[:-1]))
        first = np.searchsorted(at, np.append(0, ends))  # each text's first piece
        at = np.append(at, len(chars))
        if len(raw) != len(chars):  # plain characters have one or two bytes
            at = np.append(0, np.cumsum(1 + (chars >= 0x80)))[at]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        known = [self.known[p] for p in pieces.dictionary.to_pylist()]
        sizes, which = np.array([len(x) // 4 for x in known]), pieces.indices.to_numpy()
        begin, count = (np.cumsum(sizes) - sizes)[which], sizes[which]
        stop = np.append(0, np.cumsum(count))
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(begin - stop[:-1], count) + np.arange(stop[-1])].tobytes()
        cuts = (4 * stop[first]).tolist()
        return [ids[a:b] for a, b in pairwise(cuts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


BLOCK_SCHEMA = "part int, block int, bits int, n bigint, before bigint, doc_ids array<bigint>, ends array<bigint>, payload binary"


def _packer(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        bits, end = width(max(encode.size, end_id + 1)), np.array([end_id], "<u4").tobytes()
        held, ids, ends, n, before, block, part = [], [], [], 0, 0, 0, 0

        def packed() -> pa.RecordBatch:
            row = {"part": part, "block": block, "bits": bits, "n": n, "before": before, "doc_ids": ids, "ends": ends, "payload": pack(np.frombuffer(b"".join(held), "<u4"), bits)}
            return pa.RecordBatch.from_pylist([row], FILE)

        for batch in slices(batches, "text", TEXT_BYTES):
            texts = encode.many([t or "" for t in batch.column("text").to_pylist()])
            for part, key, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                held.append(text + end)
                n += len(held[-1]) // 4
                ids.append(key)
                ends.append(n)
                if n >= block_ids:
                    yield packed()
                    held, ids, ends, before, n, block = [], [], [], before + n, 0, block + 1
        if ids:
            yield packed()

    return run


FILE = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("n", pa.int64()), ("before", pa.int64())]
    + [("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> Stored:
    """Encode, pack and write all documents in ascending order of doc_id."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // PART_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return Stored(rows.mapInArrow(_packer(tokenizer, end_id, block_ids), BLOCK_SCHEMA), "token-blocks")


def _read(first: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                starts = [0, *r["ends"][:-1]]
                docs = [unpack(r["payload"], r["bits"], a, b).astype("<u4") for a, b in zip(starts, r["ends"], strict=True)]
                base = first[r["part"]] + r["before"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()), pa.array([base + a for a in starts], pa.int64()),
                        pa.array([len(d) for d in docs], pa.int64()), pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_back(blocks: DataFrame) -> DataFrame:
    """Per document, from the files: where its ids start in the whole output,
    how many it has, and the CRC-32 of them as little-endian 32-bit integers."""
    parts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one number a part
    first, total = {}, 0
    for part in sorted(parts):
        first[part], total = total, total + parts[part]
    return blocks.mapInArrow(_read(first), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
