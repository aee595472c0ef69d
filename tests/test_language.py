"""Predicates and scalars as text, exact sums, time bounds, stored versions."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.errors import Conflict, Refused, TenantRequired
from lodestone.functions import P, S
from lodestone.functions.language import as_predicate, as_scalar, parse_predicate
from lodestone.functions.predicates import And, Compare, CompareColumns, In, IsNull, Like, Matches, Not, Or, implies
from lodestone.operators.aggregates import aggregate
from lodestone.plans.lower import scope_of
from lodestone.plans.spec import Agg, Grouping, Query
from lodestone.queries import engine
from lodestone.schema import table_of
from lodestone.security import Context
from lodestone.sources import VersionedTable, publish
from lodestone.sources.tables import time_bounds

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("text,want", [
    ("a = 1", Compare("a", "=", 1)), ("a <> -2.5", Compare("a", "<>", -2.5)), ("a <= b", CompareColumns("a", "<=", "b")), ("a IS NOT NULL", Not(IsNull("a"))),
    ("a LIKE 'x%' OR NOT b ILIKE 'it''s'", Or((Like("a", "x%"), Not(Like("b", "it's", True))))), ("a !~* 'x'", Not(Matches("a", "x", True))),
    ("a NOT IN (1, 2)", Not(In("a", (1, 2)))), ("a IN (b, 2)", Or((CompareColumns("a", "=", "b"), Compare("a", "=", 2)))),
    ("a = 1 OR b = 2 AND c = 3", Or((Compare("a", "=", 1), And((Compare("b", "=", 2), Compare("c", "=", 3)))))), ("a = [1, 2]", Compare("a", "=", [1, 2])),
    ("(a = 1 OR b = true) AND TRUE", And((Or((Compare("a", "=", 1), Compare("b", "=", True))), P.TRUE))),
])
def test_predicate_text(text, want):
    assert parse_predicate(text) == want


@pytest.mark.parametrize("text", ["", "a =", "a = 1 extra", "a LIKE 3", "a IN ()", "a ? 1", "not", "a = :nobody", "select = 1 2", "a BETWEEN 1 AND 2"])
def test_predicate_text_refused(text):
    with pytest.raises(Refused):
        as_predicate(text)


def test_the_caller_is_put_in():
    ctx = Context(principal="p", tenant=4)
    assert as_predicate("a = :principal AND t IN (:tenant, 5)", ctx) == And((Compare("a", "=", "p"), In("t", (4, 5))))
    with pytest.raises(Refused):
        as_predicate("a = :principal")
    with pytest.raises(TenantRequired):
        as_predicate("a = :tenant", Context(principal=1))


def test_scalar_text():
    assert as_scalar("lower(a)") == S.lower("a") and as_scalar("a + 2 * b") == S.col("a") + S.lit(2) * S.col("b")
    assert as_scalar("CASE WHEN a > 1 THEN concat('x', b) END") == S.case([(Compare("a", ">", 1), S.concat("x", S.col("b")))], S.lit(None))
    with pytest.raises(Refused):
        as_scalar("nothing(a)")


def test_nan_implies_nothing():
    nan = float("nan")
    assert not implies(Compare("x", "=", 1.0), Compare("x", ">", nan)) and not implies(Compare("x", "=", nan), Compare("x", ">", 1.0))


def test_a_group_that_is_not_there_is_empty(spark):
    df = spark.createDataFrame([("abc",)], "s string")
    assert df.select(S.regexp_replace("s", "(b)", r"[\1\2]").column(scope_of(df))).first()[0] == "a[b]c"


INTS = st.one_of(st.integers(-(1 << 63), (1 << 63) - 1), st.integers(-9, 9), st.sampled_from([(1 << 63) - 1, -(1 << 63), 1 << 62]))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), INTS), max_size=12))
def test_sums_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    known = [v for v in values if v is not None]
    want = sum(known) if known and -(1 << 63) <= sum(known) < 1 << 63 else None
    assert df.agg(aggregate(Agg.sum("v", "s"), scope_of(df)).alias("s")).first()[0] == want


def test_shifted_sums(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, None, 2), (2, -7, 3), (3, None, 4)], "g int, v int, id int")
    e = Engine(spark).add(table_of("t", df, ["id"]), df)
    q = Query("t").compute("a", S.col("v") + 3).compute("b", S.col("v") - 2).compute("c", S.col("a") * 2)
    g = Grouping().group_by("g").aggregate(Agg.sum("a", "sa"), Agg.sum("b", "sb"), Agg.sum("c", "sc"))
    assert sorted(map(tuple, e.grouped(q, g).collect())) == [(1, 8, 3, 16), (2, -4, -9, -8), (3, None, None, None)]
    assert tuple(e.aggregate(Query("t").compute("z", S.col("v") + 1).where(P.cmp("id", ">", 9)), Agg.sum("z", "s")).first()) == (None,)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_bounds_reach_the_scan(spark):
    e = engine(spark, SF)
    for op, v, pushed in (("<=", 904694400, "LessThan(l_shipdate,1998-09-02"), (">", 800000000, "GreaterThanOrEqual(l_shipdate,1995-05-09")):
        df = e.query(Query("lineitem").where(P.cmp("l_shipdate", op, v)).select("l_orderkey"))
        assert pushed in plan_of(df).split("PushedFilters", 1)[1]


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_time_bounds_leave_nothing_out(spark, op):
    times = ["1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "1970-01-01 00:00:00.9", "1970-01-01 00:00:01", "0001-01-01 00:00:00", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"), F.col("t").cast("date").alias("d"))
    for name in ("t", "d"):
        for v in (-86400, -1, 0, 1, 86399, 10**15):
            p = P.cmp(name, op, v)
            seconds = df.withColumn("s", F.unix_seconds(F.col(name).cast("timestamp")))
            bound = time_bounds(df, p)
            lost = seconds.where(P.cmp("s", op, v).column(scope_of(seconds.select("s"))))
            assert bound is None or lost.where(~F.coalesce(bound, F.lit(False))).count() == 0


def test_partial_copies_follow_their_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 50)], "id bigint, v bigint")
    e = Engine(spark).add(table_of("t", df, ["id"]), df)
    e.materialise("t", "v > 10", str(tmp_path / "copy"))
    big = Query("t").where(P.cmp("v", ">", 20))
    assert "copy" in plan_of(e.query(big)) and "copy" not in plan_of(e.query(Query("t")))
    e.writer().insert("t", [{"id": 3, "v": 60}])
    assert e.count(big) == 2 and "copy" not in plan_of(e.query(big))
    e.refresh("t")
    assert e.count(big) == 2 and "copy" in plan_of(e.query(big))


def test_appends_and_commits(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / n), ["id"]) for n in "ab")
    row = lambda i: spark.createDataFrame([(i,)], "id bigint")
    assert [one.write(row(1)), one.append(row(2)), two.write(row(7))] == [1, 2, 1]
    assert len(one._parts(2)) == 2 and sorted(r.id for r in one.read().collect()) == [1, 2]
    with pytest.raises(Conflict):  # the second table is not at version 0
        publish([(one, row(3), 2, True), (two, row(8), 0, True)])
    assert one.versions() == [1, 2] and two.versions() == [1]
    assert publish([(one, row(3), 2, True), (two, row(8), 1, False)]) == [3, 2]
    assert one.read().count() == 3 and [r.id for r in two.read().collect()] == [8]
    one.mark(3, ["nothing"], str(tmp_path / "never"))  # a writer that went away before its commit
    assert one.current == 3 and one.versions() == [1, 2, 3] and one.recover() == [4] and one.append(row(9)) == 4


def test_decimal_sums_stay_exact(spark):
    df = spark.createDataFrame([(Decimal("0.10"),)] * 100, "d decimal(18,2)")
    assert df.agg(aggregate(Agg.sum("d", "s"), scope_of(df)).alias("s")).first()[0] == Decimal("10.00")
