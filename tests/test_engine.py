"""Queries, joins, windows, pages, security, writes, SQL."""

from decimal import Decimal

import pytest

from lodestone.engine import Engine
from lodestone.errors import CheckFailed, ColumnsWithheld, Conflict, DuplicateKey, Forbidden, ForeignKeyFailed, InvalidCursor, NoSuchColumn, NotSummable, Refused, RowNotFound, SchemaError, TenantRequired, TypeMismatch, WriteError
from lodestone.functions import P, S
from lodestone.operators.relations import load_nested
from lodestone.plans.spec import Agg, Chain, Grouping, Query, Window, desc, join
from lodestone.schema import CREATED, UPDATED, Check, ColumnDef, ForeignKey, IndexDef, TableDef, widened
from lodestone.security import READ, UPDATE, Context, Policy, Security
from lodestone.sources import VersionedTable, memory, seed_toml
from lodestone.sources.tables import cycle, factory, null_for, seeded
from lodestone.sql import parse
from lodestone.types import F64, I64, STR, ValueType, array, decimal, to_decimal

AUTHORS = TableDef("authors", (ColumnDef("id", I64), ColumnDef("name", STR), ColumnDef("age", I64, True)), ("id",), checks=(Check("grown", P.cmp("age", ">", 17)),))
BOOKS = TableDef(
    "books", (ColumnDef("id", I64), ColumnDef("author_id", I64, True), ColumnDef("title", STR), ColumnDef("price", decimal(2), True)), ("id",),
    indexes=(IndexDef("by_title", ("title",), unique=True),), foreign_keys=(ForeignKey(("author_id",), "authors", "cascade"),),
)
REVIEWS = TableDef("reviews", (ColumnDef("id", I64), ColumnDef("book_id", I64), ColumnDef("stars", I64)), ("id",), foreign_keys=(ForeignKey(("book_id",), "books"),))
FILES = TableDef("files", (ColumnDef("id", I64), ColumnDef("owner", STR), ColumnDef("deleted_at", I64, True), ColumnDef("made", I64, managed=CREATED), ColumnDef("seen", I64, managed=UPDATED)), ("id",), soft_delete="deleted_at")


@pytest.fixture
def e(spark):
    out = Engine(spark)
    authors = [{"id": 1, "name": "Le Guin", "age": 88}, {"id": 2, "name": "Lem", "age": None}, {"id": 3, "name": "Nobody"}]
    books = [{"id": 10, "author_id": 1, "title": "Earthsea", "price": "7.10"}, {"id": 11, "author_id": 1, "title": "Darkness", "price": "0.10"}, {"id": 12, "author_id": 2, "title": "Solaris"}, {"id": 13, "title": "Anon", "price": 3}]
    for t, rows in ((AUTHORS, authors), (BOOKS, books), (REVIEWS, [{"id": 100, "book_id": 12, "stars": 5}])):
        out.add(t, memory(spark, t, rows))
    return out


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


# --- definitions ---


@pytest.mark.parametrize(
    "change",
    [
        {"columns": (ColumnDef("id", I64), ColumnDef("id", I64))}, {"primary_key": ()}, {"primary_key": ("nope",)}, {"columns": (ColumnDef("id", I64, True),)}, {"tenant": "name"}, {"soft_delete": "name"}, {"soft_delete": "nope"},
        {"columns": (ColumnDef("id", I64), ColumnDef("a", array(ValueType.ARRAY)))}, {"columns": (ColumnDef("id", I64), ColumnDef("d", decimal(19)))}, {"columns": (ColumnDef("id", I64), ColumnDef("t", STR, managed=CREATED))},
        {"indexes": (IndexDef("i", ("id",), text=True),)}, {"indexes": (IndexDef("i", ("id",)), IndexDef("i", ("id",)))}, {"checks": (Check("c", P.TRUE), Check("c", P.TRUE))}, {"foreign_keys": (ForeignKey((), "x"),)},
    ],
)
def test_definitions_are_refused(change):
    with pytest.raises(SchemaError):
        TableDef(**{"name": "t", "columns": (ColumnDef("id", I64), ColumnDef("name", STR)), "primary_key": ("id",)} | change)


def test_migrations(spark):
    new = TableDef("authors", (ColumnDef("id", I64), ColumnDef("full_name", STR, previous_names=("name",)), ColumnDef("age", I64, True), ColumnDef("rank", I64, default=5)), ("id",), version=2)
    assert widened(AUTHORS, new) == ["rename column name to full_name", "add column rank", "record version 2"]
    old = memory(spark, AUTHORS, [{"id": 1, "name": "A"}])
    assert tuple(new.read(old).first()) == (1, "A", None, 5)
    for bad in ((ColumnDef("id", I64),), (ColumnDef("id", I64), ColumnDef("name", I64), ColumnDef("age", I64, True)), (ColumnDef("id", I64), ColumnDef("name", STR), ColumnDef("age", I64, True), ColumnDef("x", I64))):
        with pytest.raises(SchemaError):
            widened(AUTHORS, TableDef("authors", bad, ("id",), version=2))


def test_exact_decimals(e):
    assert e.aggregate(Query("books"), Agg.sum("price", "s"), Agg.avg("price", "a")).first().asDict() == {"s": Decimal("10.20"), "a": pytest.approx(340.0)}
    assert to_decimal("1.50", 2) == Decimal("1.50")
    with pytest.raises(Refused):
        to_decimal("1.505", 2)


# --- queries ---


def test_query_parts(e):
    q = Query("books").compute("twice", S.col("id") * 2).where(P.cmp("twice", ">", 20)).sort(desc("id")).limit(2).select("id", "twice")
    assert [tuple(r) for r in e.query(q).collect()] == [(13, 26), (12, 24)]
    assert e.query(Query("books").select_none()).columns == [] and e.count(Query("books").sort("id").limit(1)) == 4
    assert ids(e.get_many("books", [(10,), (99,)])) == [10]
    for bad in (
        Query("books").compute("a", S.col("b") + 1).compute("b", S.lit(1)), Query("books").select("nope"), Query("books").using_index("nope"), Query("books").compute("id", S.lit(1)),
        Query("books").window(Window.rank("r").over(["id"])), Query("books").window(Window.lag("l", "id", 0).over([], ["id"])), Query("books").window(Window.aggregate(Agg.count_distinct("id", "d")).over([], ["id"])),
        Query("books").paging().sort("title"), Query("books").paging().window(Window.row_number("r").over([], ["id"])), Query("books").paging().offset(3), Query("nope"),
    ):
        with pytest.raises(Refused):
            e.query(bad)
    with pytest.raises(InvalidCursor):
        e.query(Query("books").after(1, 2))
    with pytest.raises(InvalidCursor):
        e.query(Query("books").after("x"))
    with pytest.raises(NotSummable):
        e.aggregate(Query("books"), Agg.sum("title"))


def test_pages_are_the_whole(e):
    seen, cursor = [], None
    while True:
        q = Query("books").limit(3)
        page = [r.id for r in e.query(q.paging() if cursor is None else q.after(cursor)).collect()]
        if not page:
            break
        seen, cursor = seen + page, page[-1]
    assert seen == [10, 11, 12, 13]


def test_joins_agree_under_every_algorithm(e):
    want = {"inner": 3, "left": 4, "right": 4, "full": 5}
    for how, n in want.items():
        for using in (None, "hash", "broadcast", "merge", *(["nested_loop"] if how in ("inner", "left") else [])):
            assert e.join(join(Query("authors"), Query("books"), [("authors.id", "author_id")], how, using=using)).count() == n
    c = join(Query("authors"), Query("books"), [("authors.id", "author_id")], "left", having=P.cmp("title", "=", "Darkness"))
    assert sorted((r.authors_id, r.title) for r in e.join(c).collect()) == [(1, "Darkness"), (2, None), (3, None)]
    g = Grouping().group_by("name").aggregate(Agg.count_column("books.id", "n"))
    assert {r["name"]: r.n for r in e.grouped_join(join(Query("authors"), Query("books"), [("authors.id", "author_id")], "left"), g).collect()} == {"Le Guin": 2, "Lem": 1, "Nobody": 0}
    for bad in (lambda: join(Query("authors"), Query("books"), []), lambda: join(Query("authors"), Query("books"), [("id", "id")], "cross"), lambda: join(Query("authors"), Query("books"), [("id", "id")], "full", using="nested_loop")):
        with pytest.raises(Refused):
            bad()
    for bad in (join(Query("authors"), Query("authors"), [("id", "id")]), join(Query("authors"), Query("books"), [("name", "id")]), join(Query("authors"), Query("books"), [("id", "id")]).paging(), join(Query("authors").limit(1), Query("books"), [("id", "id")], "right").paging(), Chain(Query("authors"))):
        with pytest.raises(Refused):
            e.join(bad)
    e.warnings.clear()
    e.join(join(Query("authors"), Query("books"), [("authors.id", "author_id")]).compute("x", S.col("id") + 1))
    assert "authors.id is meant" in e.warnings[0]


def test_windows_share_values_among_peers(spark):
    t = TableDef("sales", (ColumnDef("id", I64), ColumnDef("region", STR), ColumnDef("amount", I64)), ("id",))
    e = Engine(spark).add(t, memory(spark, t, [{"id": i, "region": "r", "amount": a} for i, a in enumerate([10, 10, 20])]))
    q = Query("sales").window(Window.aggregate(Agg.sum("amount", "run")).over(["region"], ["amount"])).window(Window.rank("rk").over(["region"], ["amount"])).window(Window.dense_rank("dr").over(["region"], ["amount"]))
    assert [(r.run, r.rk, r.dr) for r in e.query(q.sort("id")).collect()] == [(20, 1, 1), (20, 1, 1), (40, 3, 2)]


def test_views_and_partial_copies(e, tmp_path):
    e.add_view("cheap", "books", P.cmp("price", "<", "1.00"))
    assert ids(e.query(Query("cheap"))) == [11]
    with pytest.raises(NoSuchColumn):
        e.join(join(Query("cheap"), Query("authors"), [("author_id", "id")]))
    with pytest.raises(Refused):
        e.writer().insert("cheap", [])
    e.materialise("books", P.cmp("id", ">", 11), str(tmp_path / "p"))
    assert ids(e.query(Query("books").where(P.cmp("id", ">", 12)))) == [13] and "p" in e.explain(Query("books").where(P.cmp("id", ">", 12))).plan
    assert ids(e.query(Query("books").where(P.cmp("id", ">", 10)))) == [11, 12, 13]


def test_plans(spark):
    e = Engine(spark).add_parquet("orders", "/root/testdata/sf0.001/orders.parquet", ["o_orderkey"])
    plan = e.explain(Query("orders").where(P.cmp("o_orderkey", ">", 5)).select("o_orderkey", "o_totalprice")).plan
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert "TakeOrderedAndProject" in e.explain(Query("orders").sort("o_totalprice").limit(3)).plan
    stats = e.analyze("orders", ["o_orderstatus", "o_totalprice"])
    assert stats.columns["o_orderstatus"].distinct == 3 and len(stats.columns["o_totalprice"].histogram) == 63


def test_sources(spark, e):
    made = seed_toml(spark, e.catalog, '[[authors]]\nid = 5\nname = "X"\n')
    assert tuple(made["authors"].first()) == (5, "X", None)
    from pyspark.sql import functions as F

    df = factory(spark, 6, {"id": F.col("id"), "c": cycle(["a", "b"]), "n": null_for(seeded(1, 10), 3)})
    assert [r.c for r in df.orderBy("id").collect()] == ["a", "b"] * 3 and df.where("n is null").count() == 2
    nested = load_nested([(e.query(Query("books")), [("id", "author_id")], "books", ["id"]), (e.query(Query("reviews")), [("id", "book_id")], "reviews", ["id"])], e.query(Query("authors")))
    assert {r["name"]: [len(b.reviews) for b in r.books] for r in nested.collect()} == {"Le Guin": [0, 0], "Lem": [1], "Nobody": []}


# --- security, on every path ---


def test_policies_hold_on_every_path(e):
    s = Security().grant("r", "books", READ).grant("r", "authors", READ).policy(Policy("books", lambda c: P.cmp("author_id", "=", c.principal)))
    e.security, me = s, Context(principal=1, roles=("r",))
    assert ids(e.query(Query("books"), me)) == [10, 11] and e.count(Query("books"), me) == 2 and e.get("books", 12, ctx=me).collect() == []
    assert ids(e.query(Query("books").sort(desc("id")).limit(1), me)) == [11] and ids(e.query(Query("books").after(10).limit(9), me)) == [11]
    assert e.query(Query("books").window(Window.aggregate(Agg.count("n")).over([])), me).first().n == 2
    assert e.join(join(Query("authors"), Query("books"), [("authors.id", "author_id")]), me).count() == 2
    assert e.sql("SELECT count(*) AS n FROM books", me).first().n == 2 and e.analyze("books", ["id"], me).rows == 2
    e.security.policies.append(Policy("authors", lambda c: P.TRUE, roles=("other",)))
    assert e.query(Query("authors"), me).count() == 0
    for call in (lambda: e.query(Query("reviews"), me), lambda: e.explain(Query("books"), ctx=me), lambda: e.writer(me).insert("books", [])):
        with pytest.raises(Forbidden):
            call()
    e.security.grant_columns("r", BOOKS, "id", "author_id")
    assert e.query(Query("books"), me).columns == ["id", "author_id"]
    for q in (Query("books").where(P.cmp("title", "=", "x")), Query("books").sort("title"), Query("books").compute("n", S.length("title")), Query("books").select("title")):
        with pytest.raises(ColumnsWithheld):
            e.query(q, me)
    with pytest.raises(Forbidden):
        Security().grant_columns("r", BOOKS, "title")


def test_tenants(spark):
    t = TableDef("docs", (ColumnDef("tenant", STR), ColumnDef("id", I64)), ("tenant", "id"), tenant="tenant")
    e = Engine(spark, security=Security().grant("r", "docs")).add(t, memory(spark, t, [{"tenant": "a", "id": 1}, {"tenant": "b", "id": 2}]))
    assert ids(e.query(Query("docs"), Context(roles=("r",), tenant="a"))) == [1] and e.count(Query("docs")) == 2
    with pytest.raises(TenantRequired):
        e.query(Query("docs"), Context(roles=("r",)))
    with pytest.raises(Forbidden):
        e.writer(Context(roles=("r",), tenant="a")).insert("docs", [{"tenant": "b", "id": 3}])


# --- writes ---


def test_writes_are_checked(e):
    w = e.writer()
    for error, call in (
        (DuplicateKey, lambda: w.insert("authors", [{"id": 1, "name": "x"}])), (DuplicateKey, lambda: w.insert("authors", [{"id": 7, "name": "x"}, {"id": 7, "name": "y"}])), (CheckFailed, lambda: w.insert("authors", [{"id": 7, "name": "x", "age": 3}])),
        (DuplicateKey, lambda: w.insert("books", [{"id": 20, "title": "Solaris"}])), (ForeignKeyFailed, lambda: w.insert("books", [{"id": 20, "title": "New", "author_id": 99}])), (RowNotFound, lambda: w.update("authors", [{"id": 99, "name": "x"}])),
        (ForeignKeyFailed, lambda: w.delete("authors", [(2,)])), (RowNotFound, lambda: w.delete("authors", [(99,)])), (WriteError, lambda: w.delete_where("books", P.TRUE, 2)), (Refused, lambda: w.update_where("books", P.TRUE, [("title", S.lit("a")), ("title", S.lit("b"))])),
        (RowNotFound, lambda: w.update_if_unchanged("authors", [{"id": 1, "name": "other", "age": 88}], [{"id": 1, "name": "x"}])), (SchemaError, lambda: w.insert("authors", [{"id": 8}])),
    ):
        with pytest.raises(error):
            call()
    assert e.count(Query("authors")) == 3 and e.count(Query("books")) == 4
    w.insert("authors", [{"id": 4, "name": "New", "age": None}])
    w.update_if_unchanged("authors", [{"id": 4, "name": "New"}], [{"id": 4, "name": "Newer"}])
    w.upsert("authors", [{"id": 4, "name": "Newest"}, {"id": 5, "name": "Five"}])
    assert {r["name"] for r in e.query(Query("authors").where(P.cmp("id", ">", 3))).collect()} == {"Newest", "Five"}
    assert w.delete("authors", [(1,)]) == 3 and ids(e.query(Query("books"))) == [12, 13]
    w.update_where("books", P.cmp("id", "=", 13), [("title", S.concat(S.col("title"), "!")), ("price", S.col("price") * 2)])
    assert e.get("books", 13).first().asDict() == {"id": 13, "author_id": None, "title": "Anon!", "price": Decimal("6.00")}
    assert ids(w.delete_where("books", P.cmp("title", "=", "Anon!"))) == [13] and e.count(Query("books")) == 1
    with pytest.raises(DuplicateKey):
        w.batch([("insert", ("authors", [{"id": 6, "name": "a"}])), ("insert", ("authors", [{"id": 6, "name": "b"}]))])
    assert e.count(Query("authors").where(P.cmp("id", "=", 6))) == 0
    out = w.batch([("insert", ("authors", [{"id": 6, "name": "a"}])), ("insert", ("authors", [{"id": 6, "name": "b"}]))], all_or_nothing=False)
    assert isinstance(out[1], DuplicateKey) and e.count(Query("authors").where(P.cmp("id", "=", 6))) == 1


def test_soft_deletes(spark):
    e, now = Engine(spark), [100]
    e.add(FILES, memory(spark, FILES, []))
    w = e.writer(clock=lambda: now[0])
    w.insert("files", [{"id": 1, "owner": "a"}, {"id": 2, "owner": "b"}])
    now[0] = 200
    w.update("files", [{"id": 1, "owner": "c"}])
    assert [(r.made, r.seen) for r in e.query(Query("files").sort("id")).collect()] == [(100, 200), (100, 100)]
    w.delete("files", [(1,)])
    assert ids(e.query(Query("files"))) == [2] and ids(e.query(Query("files").include_deleted())) == [1, 2]
    with pytest.raises(DuplicateKey):
        w.insert("files", [{"id": 1, "owner": "again"}])
    w.purge_deleted("files", 200)
    assert ids(e.query(Query("files").include_deleted())) == [1, 2]
    w.purge_deleted("files", 201)
    assert ids(e.query(Query("files").include_deleted())) == [2]
    e.security = Security().grant("r", "files", READ, UPDATE)
    with pytest.raises(Forbidden):
        e.query(Query("files").include_deleted(), Context(roles=("r",)))


def test_versions(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"), ["id"])
    assert store.write(memory(spark, AUTHORS, [{"id": 1, "name": "a"}])) == 1
    e = Engine(spark).add(AUTHORS, store)
    assert e.writer().insert("authors", [{"id": 2, "name": "b"}]) == 2 and ids(e.query(Query("authors"))) == [1, 2]
    assert ids(store.read(1)) == [1]
    with pytest.raises(Conflict):
        store.write(memory(spark, AUTHORS, []), expected=1)
    with pytest.raises(SchemaError):
        store.read(at_least=3)


# --- SQL ---


def test_sql(e):
    rows = lambda t: [tuple(r) for r in e.sql(t).collect()]
    assert rows("SELECT id FROM books WHERE author_id IN (SELECT id FROM authors WHERE name LIKE 'Le%') ORDER BY id") == [(10,), (11,), (12,)]
    assert rows("SELECT name, count(*) AS n FROM authors JOIN books ON authors.id = author_id GROUP BY name ORDER BY count(*) DESC LIMIT 1") == [("Le Guin", 2)]
    assert rows("WITH b AS (SELECT id, title FROM books WHERE id > 11) SELECT title FROM b ORDER BY id") == [("Solaris",), ("Anon",)]
    e.sql("INSERT INTO authors VALUES (9, 'Nine', NULL)")
    e.sql("UPDATE authors SET name = 'IX' WHERE id = 9")
    assert rows("SELECT name FROM authors WHERE id = 9") == [("IX",)]
    e.sql("DELETE FROM authors WHERE id = 9")
    assert rows("SELECT name FROM authors WHERE id = 9") == []
    assert rows("SELECT id FROM books WHERE author_id NOT IN (SELECT author_id FROM books)") == []


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM a UNION SELECT * FROM b", "SELECT * FROM a WHERE x = 1 AND y = 2 OR z = 3", "SELECT * FROM a AS b", "SELECT x, count(*) FROM a", "SELECT x FROM a HAVING x = 1", "SELECT DISTINCT x FROM a GROUP BY x", "SELECT DISTINCT * FROM a",
        "SELECT x FROM a JOIN b ON p = q", "SELECT * FROM a JOIN b ON p = q ORDER BY x", "SELECT count(*) FROM a JOIN b ON p = q", "SELECT * FROM a CROSS JOIN b", "SELECT * FROM a LEFT JOIN b ON p = q", "SELECT * FROM a, b", "SELECT * FROM a WHERE EXISTS (SELECT x FROM b)",
        "INSERT INTO a (x) VALUES (1)", "SELECT * FROM a WHERE x BETWEEN 1 AND 2", "SELECT * FROM a WHERE x IS NULL", "SELECT * FROM a WHERE x NOT LIKE 'y'", "SELECT * FROM a WHERE x IN (SELECT y FROM b LIMIT 1)", "SELECT * FROM a WHERE x IN (SELECT y, z FROM b)",
        "WITH RECURSIVE c AS (SELECT * FROM a) SELECT * FROM c", "WITH c AS (SELECT * FROM a), d AS (SELECT * FROM a) SELECT * FROM c", "WITH c AS (SELECT * FROM a) SELECT * FROM b", "WITH c(x) AS (SELECT y FROM a) SELECT * FROM c", "WITH c AS (SELECT x FROM a) SELECT y FROM c",
        "SELECT sum(x) OVER (ROWS UNBOUNDED PRECEDING) FROM a", "SELECT rank() FROM a", "SELECT ntile(3) OVER (ORDER BY x) FROM a", "SELECT sum(*) FROM a", "SELECT hour(x, 'Mars/Base') FROM a", "SELECT * FROM a WHERE x = y", "SELECT * FROM a WHERE count(*) > 1", "SELECT * FROM a extra tokens", "DROP TABLE a", "SELECT * FROM a WHERE x ~ '(('",
        "SELECT rank() OVER (ORDER BY x), count(*) FROM a GROUP BY y", "SELECT * FROM a WHERE x = 1 #",
    ],
)
def test_sql_refusals(text):
    with pytest.raises(Refused):
        parse(text)


def test_sql_writes_need_the_key(e):
    with pytest.raises(Refused):
        e.sql("DELETE FROM authors WHERE name = 'Lem'")
    with pytest.raises(TypeMismatch):
        e.sql("SELECT id FROM books WHERE id IN (SELECT name FROM authors)")
    with pytest.raises(TypeMismatch):
        e.query(Query("books").where(P.cmp("id", "=", 1.5)))


def test_doubles_are_their_own_kind(spark):
    t = TableDef("m", (ColumnDef("id", I64), ColumnDef("x", F64)), ("id",))
    e = Engine(spark).add(t, memory(spark, t, [{"id": 1, "x": 0.5}, {"id": 2, "x": float("nan")}]))
    assert str(e.aggregate(Query("m"), Agg.max("x", "hi")).first().hi) == "nan"
