"""Learners and pipeline held to plain versions of what they should give."""

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import ordinal_quality, quality_rules, simhash_vptree, soft_mixing


def test_ordinal_fit_is_where_the_gradient_of_the_likelihood_is_zero():
    rng = np.random.default_rng(4)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(90)]
    grades = np.array([min(2, max(0, int(round(len(r) / 2 + (0 in r) - (5 in r) + rng.normal(0, 0.7))))) for r in rows])
    ridge, bits = 0.05, 3
    model = ordinal_quality.OrdinalModel.fit(rows, grades, bits, steps=3000, ridge=ridge, least_rows=1, telling=0.0)

    def loss(x):
        w, cut = x[:8], x[8:]
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            below = [0.0, *(1 / (1 + math.exp(sum(w[i] for i in r) - c)) for c in cut), 1.0]
            total -= math.log(below[g + 1] - below[g])
        return total / len(rows) + ridge / 2 * float(w @ w)

    at = np.r_[model.weights.astype(float), model.thresholds]
    for k, step in enumerate(np.eye(len(at)) * 1e-5):
        assert abs(loss(at + step) - loss(at - step)) / 2e-5 < 2e-3, k
    assert (np.diff(model.thresholds) > 0).all()


def test_selection_is_the_plain_sum_of_weights(spark):
    rng = np.random.default_rng(5)
    model = ordinal_quality.OrdinalModel(rng.normal(size=1 << 10).astype(np.float32), np.array([-1.0, 0.5]), 10)
    texts = ["one two two three.", "SHOUT! and # marks", "", None, " \n", "x " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in ordinal_quality.select(docs, model).collect()}
    for k, t in enumerate(texts):
        score = sum(float(model.weights[i]) for i in set(ordinal_quality.features(t, 10)))
        over = [1 - 1 / (1 + math.exp(score - c)) for c in model.thresholds]
        assert got[k].expected_grade == pytest.approx(sum(over), abs=1e-5) and got[k].tail_probability == pytest.approx(over[1], abs=1e-5)
        assert got[k].kept == (got[k].tail_probability >= 0.5)


def test_posterior_is_that_of_naive_bayes(spark):
    weights = {"a": [0.7, 0.2, 0.1], "b": [0.1, 0.6, 0.2], "é": [0.3, 0.3, 0.9]}
    priors = [0.5, 0.3, 0.2]
    texts = ["a b", "A a a", "É, b", "nothing known", "", None, "b. a! é"]
    known = [{"a", "b"}, {"a"}, {"é", "b"}, set(), set(), set(), {"a", "b", "é"}]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in soft_mixing.with_posterior(docs, soft_mixing.DomainModel(["x", "y", "z"], priors, weights)).collect()}
    for k, own in enumerate(known):
        p = np.array(priors) * [math.prod(q[i] if w in own else 1 - q[i] for w, q in weights.items()) for i in range(3)]
        assert got[k]._p == pytest.approx(list(p / p.sum()), abs=1e-9)
    assert [got[k]._n for k in range(7)] == [2, 3, 3, 2, 0, 0, 5]


def _rows(spark, seed):
    rng = np.random.default_rng(seed)
    data = []
    for k in range(300):
        x, y = float(rng.integers(0, 12)), float(rng.integers(0, 4))
        data.append((x, y, 1.0, bool(x > 8 or rng.random() < 0.05), k % 3))
    return data, spark.createDataFrame(data, "x double, y double, same double, bad boolean, fold int")


@pytest.mark.parametrize("seed", [1, 2])
def test_first_condition_has_the_best_gain(spark, seed):
    data, rows = _rows(spark, seed)
    (rule,) = quality_rules.learn(rows, ["x", "y", "same"], max_rules=1, max_conditions=1, precision=0.5).rules
    grow = [r for r in data if r[4]]
    p0 = sum(r[3] for r in grow)

    def gain(k, above, t):
        met = [r for r in grow if (r[k] > t) == above]
        p = sum(r[3] for r in met)
        return p * (math.log2(p / len(met)) - math.log2(p0 / len(grow))) if p >= 5 else 0.0

    best = max(gain(k, above, t) for k in range(3) for above in (True, False) for t in {r[k] for r in data})
    assert gain("xy".index(rule[0].feature), rule[0].above, rule[0].threshold) == pytest.approx(best)


def test_rules_of_one_class_or_constant_features(spark):
    data, rows = _rows(spark, 3)
    assert not quality_rules.learn(rows.withColumn("bad", rows["x"] < 0), ["x", "y"]).rules
    assert not quality_rules.learn(rows, ["same"]).rules
    assert not quality_rules.learn(rows.where("x < 0"), ["x", "y"]).rules


def test_a_column_named_like_the_row_number_is_ignored(spark):
    docs = spark.createDataFrame([(1, "a b c d", "r"), (2, "a b c d", "r"), (3, "e f g h", "r")], "doc_id bigint, text string, rid string")
    assert {r.doc_id: r.component_id for r in simhash_vptree.report(docs).collect()} == {1: 1, 2: 1, 3: 3}


EXTRA = "rid bigint, row string, fp string, keys string, _n int, _p int, _c int, _k int, count int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables whose documents have null and repeated ids and clashing columns."""
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    item, twin = text(40), text(120)
    extra = (7, "r", "f", "k", 1, 2, 3, 4, 5)
    rows = [(1, twin), (1, text(100)), (None, text(100)), (None, text(90)), (2, twin), (3, text(60) + " " + item), (4, ""), (5, None), (6, "few words"), (7, text(30000))]
    out = tmp_path_factory.mktemp("tables")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], schema)
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), docs.schema


def test_pipeline_of_odd_rows(spark, folder):
    got = corpus_pipeline.run(spark, folder[0]).collect()
    # kept: one of the twins (the least id), rows whose ids are null or repeat, the long text
    assert Counter(r.doc_id for r in got) == Counter([1, 1, None, None, 7])


def test_stages_give_all_columns_back(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns, name
        assert not stage(spark, docs.where("doc_id < 0"), folder[0]).collect(), name
