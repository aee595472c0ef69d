"""Every registered query of the engine that has SQL, against it."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lodestone.engine import Engine
from lodestone.plans.spec import Query
from lodestone.queries import QUERIES, SQL
from lodestone.schema import table_of
from lodestone.security import READ, Context, Policy

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(round(value, 3)) if isinstance(value, float) else int(value) if isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(plain, got.select(*[f"`{c}`" for c in columns]).collect())) == Counter(map(plain, want.fetchall()))


def test_partial_index_by_policy_keeps_all_keys(spark, tmp_path):
    rows = [(-1, "O"), (0, "O"), (None, "O"), (7, "O"), (8, "F"), (9, None)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["partial_index_by_policy"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(SQL["partial_index_by_policy"]).fetchall()
    assert len(want) == 4 and Counter(map(tuple, got.collect())) == Counter(want)
    assert got.inputFiles() and not any("orders.parquet" in f for f in got.inputFiles())  # the copy is read


def test_partial_copy_under_a_narrower_policy(spark, tmp_path):
    df = spark.createDataFrame([(0, "O"), (1, "O"), (2, "F")], "id bigint, s string")
    e = Engine(spark).add(table_of("t", df, ["id"]), df)
    e.materialise("t", "s = 'O'", str(tmp_path / "copy"))
    e.security.grant("clerk", "t", READ).policy(Policy("t", "s = 'O' AND id > 0"))
    got = e.query(Query("t"), Context(roles=("clerk",)))
    assert [r.id for r in got.collect()] == [1] and got.inputFiles()  # of the copy: the table has no files
