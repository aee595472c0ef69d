"""Where an operator once did less than the whole job."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import hidden_markov, prefix_free, secret_scan, simhash_vptree, soft_mixing, string_tiling
from lodestone.llm.common import Stored
from lodestone.llm.components import components


def edited(words, changes, rng):
    out = list(words)
    for i in rng.choice(len(out), changes, replace=False):
        out[i] = f"changed{rng.integers(1 << 30)}"
    return out


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup_removes_copies_with_a_few_changed_words(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        texts += [" ".join(edited(base, c, rng)) for c in (0, 1, max(1, len(base) // 100), len(base) // 3)]
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    want = {label.index(x) for x in set(label)}
    assert len(want) < len(texts) * 0.6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()} == want


@pytest.mark.parametrize("piece", [1 << 13, 16])
def test_near_dedup_of_one_large_group(monkeypatch, spark, piece):
    monkeypatch.setattr(simhash_vptree, "PIECE", piece)
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    docs = spark.createDataFrame([(i, " ".join(edited(base, 2, rng))) for i in range(300)] + [(None, "x y"), (900, ""), (901, None)], "doc_id bigint, text string")
    assert Counter(r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()) == Counter([0, None, 900])


@pytest.mark.parametrize("shares,targets,options", [
    ([0.98, 0.01, 0.01], [0.94, 0.03, 0.03], {}), ([0.90, 0.05, 0.05], [0.98, 0.01, 0.01], {"anchor": "a", "max_rate": 1.0}),
])
@pytest.mark.parametrize("sure", [1.0, 0.99])
def test_rare_domains_reach_their_targets(spark, shares, targets, options, sure):
    rows = [(round(10000 * s), [sure if i == k else (1 - sure) / 2 for i in range(3)]) for k, s in enumerate(shares)]
    soft = spark.createDataFrame(rows, "_n bigint, _p array<double>")
    rates = soft_mixing.fit_rates(soft, soft_mixing.DomainModel(["a", "b", "c"], shares), dict(zip("abc", targets, strict=True)), **options)
    w = np.array([r[0] for r in soft.select(rates.column(soft["_p"])).collect()])
    n, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = (w * n) @ p
    assert got / got.sum() == pytest.approx(targets, rel=0.01)
    assert [rates.totals[d][0] for d in "abc"] == pytest.approx(got)


def test_rates_are_the_least_of_the_problem(spark):
    rng = np.random.default_rng(1)
    n, p = rng.integers(1, 50, 80), rng.dirichlet([0.3] * 3, 80)
    soft = spark.createDataFrame([(int(a), list(map(float, b))) for a, b in zip(n, p, strict=True)], "_n bigint, _p array<double>")
    rates = soft_mixing.fit_rates(soft, soft_mixing.DomainModel(["a", "b", "c"], []), {"a": 0.9, "b": 0.08, "c": 0.02}, max_rate=2.0, ridge=0.01, tolerance=1e-9)
    w, s, goal = np.ones(80), n.sum(), np.array([0.9, 0.08, 0.02]) * n.sum()
    for _ in range(20000):
        w = np.clip(w - (p @ (((w * n) @ p - goal) / s) + 0.01 * (w - 1)), 0, 2.0)
    assert np.allclose([x[0] for x in soft.select(rates.column(soft["_p"])).collect()], w, atol=1e-6)


def test_weak_parts_meet_at_every_distance(spark):
    rng = np.random.default_rng(2)
    secret, weak_id = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12", "ASIAABCDEFGHIJKLMNOP"
    want, texts = Counter(), []
    for k in range(400):
        size = int(rng.integers(1, 1500))
        lead, gap = " " * int(rng.integers(0, 700)), int(rng.integers(1, 620))
        url = "https://h.x/" + "y-" * (size // 2)
        weak = url if k % 2 else secret
        parts = [secret, weak_id] if k % 2 else [weak_id]
        if k % 4 < 2:
            text, near = lead + weak + " " * gap + " ".join(parts), gap + (41 if k % 2 else 0)
        else:
            text, near = lead + " ".join(parts) + " " * gap + weak, gap + (21 if k % 2 else 0)
        texts.append((k, text))
        want[k] = near <= 300
    found = secret_scan.report(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.doc_id: ("endpoint" if r.doc_id % 2 else "wsecret") in r.spans for r in found} == dict(want)


def test_training_goes_on_until_the_likelihood_settles(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 30, 60))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "false AS held")
    told = hidden_markov.fit(docs, states=2, classes=256).likelihoods
    gains = [(b - a) / abs(a) for a, b in zip(told, told[1:], strict=False)]
    assert 6 <= len(told) < hidden_markov.PASSES and gains[-1] < hidden_markov.GAIN and all(g >= hidden_markov.GAIN for g in gains[5:-1])


@pytest.mark.parametrize("most", [string_tiling.BROADCAST_WORDS, 1])
def test_only_rows_that_hold_an_item_go(spark, most):
    item = " ".join(f"i{x}" for x in range(40))
    docs = spark.createDataFrame([(1, item), (1, "clean text"), (None, "head " + item), (None, "also clean"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    left = string_tiling.clean(docs, items, broadcast_words=most)
    assert Counter(map(tuple, left.collect())) == Counter([(1, "clean text"), (None, "also clean"), (2, None)]) and left.columns == docs.columns


def components_by_pairs(texts, similar=0.8):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return label


@pytest.mark.parametrize("piece,piece_bytes", [(1 << 13, 1 << 24), (16, 1 << 24), (16, 1 << 12)])
def test_links_beyond_the_nearest_are_found(monkeypatch, spark, piece, piece_bytes):
    for name, value in (("NEAREST", 1), ("PIECE", piece), ("PIECE_BYTES", piece_bytes)):
        monkeypatch.setattr(simhash_vptree, name, value)
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(6):  # close pairs: the nearest is the twin, other pairs are told by their sets alone
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for _ in range(int(rng.integers(3, 12))):
            near = edited(base, int(rng.integers(3, 8)), rng)
            texts += [" ".join(near), " ".join(near[:-1] + [f"end{rng.integers(1 << 30)}"])]
    label = components_by_pairs(texts)
    want = {label.index(x) for x in set(label)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()} == want
    with monkeypatch.context() as m:  # the nearest alone don't join them
        m.setattr(simhash_vptree, "rest_links", lambda *a: None)
        assert len(corpus_pipeline.dedup(spark, docs, "").collect()) > len(want)


def test_set_links_join_what_pairs_join():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 40, int(rng.integers(1, 30))).astype(np.uint32)) for _ in range(60)]
    x, low = rng.integers(0, 1 << 4, 60).astype(np.uint64), np.arange(60) % 3 > 0
    for mark in (low, np.ones(60, bool)):
        want, got = list(range(60)), list(range(60))
        for i in range(60):
            for j in range(60):
                crossed = mark.all() or mark[i] != mark[j]
                if crossed and bin(int(x[i] ^ x[j])).count("1") <= 2 and len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j])):
                    want = [want[j] if v == want[i] else v for v in want]
        for i, j in simhash_vptree.set_links(x, np.arange(60), sets, mark, 2, 0.5):
            got = [got[j] if v == got[i] else v for v in got]
        assert len({*zip(want, got, strict=True)}) == len(set(want)) == len(set(got)) > 1


@pytest.mark.parametrize("piece", [1 << 13, 40])
def test_tiles_of_a_large_shard_link_all(monkeypatch, spark, piece):
    monkeypatch.setattr(simhash_vptree, "PIECE", piece)
    monkeypatch.setattr(simhash_vptree, "LEAF", 100)
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(9)])).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in fps], "fp bigint")
    got = list(range(len(fps)))
    at = {int(v): i for i, v in enumerate(fps)}
    for r in simhash_vptree.links(df, len(fps)).collect():
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2
        got = [got[at[r.b]] if v == got[at[r.a]] else v for v in got]
    x = fps.view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    assert all(got[i] == got[j] for i, j in zip(*np.nonzero(near), strict=True))


def _brute_removed(texts, window):
    seen, out = set(), {}
    for k, t in enumerate(texts):
        cut = [False] * len(t)
        for i in range(len(t) - window + 1):
            if t[i : i + window] in seen:
                cut[i : i + window] = [True] * window
            seen.add(t[i : i + window])
        out[k] = sum(cut)
    return out


@pytest.mark.parametrize("crowd,most", [(4, 1 << 20), (4, 40), (2000, 40)])
def test_substring_dedup_in_rounds_and_by_halves(monkeypatch, spark, crowd, most):
    """A passage in every text, after and before repeated or other words: its
    triggers are crowded, and rows stay in proportion to the phrases."""
    rng, stored = np.random.default_rng(11), Counter()
    passage = "the quick brown fox jumps over"
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    befores, afters = [word(75) for _ in range(12)], [word(75) for _ in range(5)]
    texts = [word(30) + (befores[i % 12] if i % 2 else word(75)) + passage + (afters[i % 5] if i % 3 else word(75)) + word(30) for i in range(60)]
    monkeypatch.setattr(prefix_free, "MOST_PHRASES", crowd)
    monkeypatch.setattr(prefix_free, "ROUND_PHRASES", most, raising=False)
    monkeypatch.setattr(prefix_free, "ROUND_ENTRIES", most, raising=False)
    drop = Stored.drop
    monkeypatch.setattr(Stored, "drop", lambda self: (stored.update({self.path.rpartition("/")[2].rpartition("-")[0]: self.df.count()}), drop(self)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in prefix_free.report(docs).collect()}
    assert got == _brute_removed(texts, 100) and any(got.values())
    assert stored["dictionary"] <= 2 * stored["phrase-firsts"]


def test_the_tree_finds_near_copies_without_a_common_bucket(spark):
    """Repeats decide the fingerprints, words that occur once the sets."""
    def close(a, b):
        x, y = (simhash_vptree.shingle_hashes(t, 5) for t in (a, b))
        keys = [set(simhash_vptree.band_keys(np.unique(h)).tolist()) for h in (x, y)]
        apart = (simhash_vptree.simhash(x) ^ simhash_vptree.simhash(y)).bit_count()
        return 1 <= apart <= simhash_vptree.REACH and not keys[0] & keys[1] and len(set(x.tolist()) & set(y.tolist())) >= 0.5 * len(set(x.tolist()) | set(y.tolist()))

    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    pairs = []
    while len(pairs) < 3:
        body = word(30) * 6
        a, b = (" ".join(body + word(10)) for _ in range(2))
        pairs += [(a, b)] * close(a, b)
    texts = [t for pair in pairs for t in pair]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash_vptree.keep_one(docs, 24, 5, 0.5).collect()) == [0, 2, 4]


def test_small_tables_of_links_are_written_by_few_tasks(monkeypatch, spark):
    kept = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in kept}
    tasks, drop = [], Stored.drop
    monkeypatch.setattr(Stored, "drop", lambda self: (tasks.append(len(self.df.inputFiles())), drop(self)))
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        links = spark.range(400).selectExpr("id AS a", "id div 20 AS b")
        assert {r.label for r in components(links).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(tasks[1:]) == 1


def test_rows_without_repeats_are_told_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id bigint, text string")
    assert prefix_free.report(docs)._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
