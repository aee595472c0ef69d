"""Rows whose ids are null or repeat under different texts, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import prefix_free, simhash_vptree, string_tiling

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
SCHEMA = "doc_id bigint, text string, rid string, row string"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(40)) for i in rng.integers(0, len(WORDS), n))


def rows():
    base, other = prose(11, 90), prose(12, 90)
    out = [(1, base), (1, other), (2, base + " tail one"), (2, "head " + other), (None, base), (None, other), (None, prose(13, 30)), (3, None), (3, "unique tail " + prose(14, 40)), (2, base + " tail one"), (None, "")]
    return [(k, t, "x", "y") for k, t in out]


def brute_repeats(texts, window):
    """Rows of one id are documents of their own, in the order given."""
    order = sorted(enumerate(texts), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
    seen, out = set(), Counter()
    for _, (k, t) in order:
        b = (t or "").encode()
        cut = [False] * len(b)
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                cut[i : i + window] = [True] * window
            seen.add(b[i : i + window])
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        spans = sum(c and (not i or not cut[i - 1]) for i, c in enumerate(cut))
        out[(k, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window,trigger,crowd", [(100, 20, 2000), (14, 5, 2), (14, 5, 2000)])
def test_substring_dedup_tells_rows_apart(monkeypatch, spark, window, trigger, crowd):
    monkeypatch.setattr(prefix_free, "MOST_PHRASES", crowd)
    docs = spark.createDataFrame(rows(), SCHEMA).coalesce(1)
    got = Counter(map(tuple, prefix_free.report(docs, window, trigger).collect()))
    assert got == brute_repeats([(k, t) for k, t, *_ in rows()], window)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=10).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12), st.lists(st.integers(0, 1), min_size=12, max_size=12), st.data())
def test_suffix_arrays_find_every_repeated_window(bodies, groups, data):
    window, trigger = 6, 2
    left = np.array([data.draw(st.integers(max(0, len(b) - window), min(window - trigger, len(b) - trigger))) for b in bodies])
    bodies = [b[: n + window] for b, n in zip(bodies, left.tolist(), strict=True)]
    group = np.array(groups[: len(bodies)])
    seen, want = set(), []
    for i, b in enumerate(bodies):
        own = []
        for a in range(window - trigger, -1, -1):
            at = left[i] - a
            if at >= 0 and at + window <= len(b):
                key = (group[i], a, b[at : at + window])
                own.append(key)
                if key in seen:
                    want.append((i, int(at)))
        seen.update(own)
    got = list(zip(*(x.tolist() for x in prefix_free.repeated_windows(bodies, left, group, window, trigger)), strict=True))
    assert got == sorted(want)


def test_keep_one_keeps_a_row_of_each_group(spark):
    a, b, c = prose(21, 60), prose(22, 60), prose(23, 60)
    docs = spark.createDataFrame([(1, a, "x", "y"), (2, a, "x", "y"), (2, c, "x", "y"), (None, b, "x", "y"), (None, b, "x", "y"), (None, a, "x", "y")], SCHEMA)
    for options in ({}, {"distance": 24, "shingle": 5, "similar": 0.8}):
        left = simhash_vptree.keep_one(docs, **options)
        assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, a), (2, c), (None, b)]) and left.columns == docs.columns


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_keep_one_with_few_and_many_copies(monkeypatch, spark, few):
    monkeypatch.setattr(simhash_vptree, "BROADCAST_ROWS", few)
    docs = spark.createDataFrame([(i, prose(30 + i % 7, 50)) for i in range(60)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash_vptree.keep_one(docs).collect()) == list(range(7))


@pytest.mark.parametrize("most", [string_tiling.BROADCAST_WORDS, 1])
def test_decontamination_tells_rows_apart(spark, most):
    item, half = prose(41, 40), " ".join(prose(41, 40).split()[:25])
    docs = spark.createDataFrame([(1, item, "x", "y"), (1, prose(42, 40), "x", "y"), (None, None, "x", "y"), (None, "a " + half, "x", "y"), (2, prose(43, 50), "x", "y"), (2, prose(43, 50), "x", "y"), (2, item, "x", "y"), (2, item, "x", "y")], SCHEMA)
    items = spark.createDataFrame([(7, item), (8, "Two words"), (7, item)], "item_id bigint, text string")
    found = Counter((r.doc_id, r.item_id, r.tiled_words) for r in string_tiling.find(docs, items, broadcast_words=most).collect())
    assert found == Counter({(1, 7, 40): 2, (None, 7, 25): 2, (2, 7, 40): 4})
    left = Counter((r.doc_id, r.text) for r in string_tiling.clean(docs, items, broadcast_words=most).collect())
    assert left == Counter([(1, prose(42, 40)), (None, None), (2, prose(43, 50)), (2, prose(43, 50))])
