"""One query for each operator, with the SQL that says what it must give."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions
from .engine import Engine
from .functions import text as fulltext
from .operators.relations import load_nested, load_one_related, load_related, load_through
from .plans.spec import Agg, Chain, Grouping, Query, Window, asc, desc, join
from .schema import IndexDef
from .security import DELETE, INSERT, READ, UPDATE, Context, Policy, Security

from .types import decimal

P, S = functions.P, functions.S
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, security: Security | None = None, **options) -> Engine:
    e = Engine(spark, security=security or Security())
    for name, key in KEYS.items():
        e.add_parquet(name, f"{sf_dir}/{name}.parquet", key, **options.get(name, {}))
    return e


def query(sql: str | None = None, **options):
    """Register a function of an engine as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(engine(spark, sf_dir, **options))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, to: int = 2) -> DataFrame:
    """Sums of doubles differ in their last bits with the order of adding."""
    return df.withColumns({n: F.round(n, to) for n in names})


# --- scans and projections ---


@query("SELECT r_regionkey, r_name FROM region")
def table_scan(e):
    return e.query(Query("region"))


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def point_get(e):
    return e.get("nation", 7)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 1000000)")
def point_gets(e):
    return e.get_many("customer", [(1,), (5,), (9,), (1000000,)]).select("c_custkey", "c_name")


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id = 3 AND turn = 0) OR (conv_id = 4 AND turn = 1)")
def point_gets_composite(e):
    return e.get_many("conversations", [(3, 0), (4, 1)]).select("conv_id", "turn", "role")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def key_range_scan(e):
    return e.query(Query("orders").where(P.cmp("o_orderkey", ">=", 100) & P.cmp("o_orderkey", "<", 400)).select("o_orderkey", "o_totalprice"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", customer={"indexes": (IndexDef("by_segment", ("c_mktsegment",)),)})
def index_scan_hint(e):
    return e.query(Query("customer").where(P.cmp("c_mktsegment", "=", "BUILDING")).using_index("by_segment").select("c_custkey", "c_mktsegment"))


@query("SELECT c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def covering_multi_range(e):
    return e.query(Query("customer").where(P.isin("c_mktsegment", ["BUILDING", "MACHINERY"])).using_table_scan().select("c_mktsegment"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 5 AND n_nationkey < 3")
def empty_plan(e):
    return e.query(Query("nation").where(P.cmp("n_nationkey", ">", 5) & P.cmp("n_nationkey", "<", 3)).select("n_nationkey", "n_name"))


@query("SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 10")
def scan_descending(e):
    return e.query(Query("part").reversed().limit(10).select("p_partkey"))


@query("SELECT DISTINCT s_nationkey FROM supplier")
def projection_distinct(e):
    return e.grouped(Query("supplier"), Grouping().group_by("s_nationkey"))


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, o_totalprice * 2 + 1 AS more FROM orders")
def computed_columns(e):
    q = Query("orders").compute("twice", S.col("o_totalprice") * 2).compute("more", S.col("twice") + 1)
    return e.query(q.select("o_orderkey", "twice", "more"))


# --- predicates ---


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_discount <= 0.05 AND l_returnflag <> 'R'")
def filter_compare(e):
    p = P.cmp("l_quantity", ">", 25) & P.cmp("l_discount", "<=", 0.05) & P.cmp("l_returnflag", "<>", "R")
    return e.aggregate(Query("lineitem").where(p), Agg.count("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_extendedprice < l_quantity * 1000")
def filter_columns(e):
    q = Query("lineitem").compute("bound", S.col("l_quantity") * 1000.0).where(P.columns("l_extendedprice", "<", "bound"))
    return e.aggregate(q, Agg.count("n"))


@query("SELECT count(*) AS n FROM (SELECT nullif(event_type, 'click') AS t FROM events) WHERE t IS NULL")
def filter_is_null(e):
    q = Query("events").compute("t", S.case([(P.cmp("event_type", "<>", "click"), S.col("event_type"))], None)).where(P.is_null("t"))
    return e.aggregate(q, Agg.count("n"))


@query("SELECT count(*) AS n FROM (SELECT nullif(event_type, 'click') AS t FROM events) WHERE NOT (t = 'view' OR t = 'click')")
def three_valued_not(e):
    q = Query("events").compute("t", S.case([(P.cmp("event_type", "<>", "click"), S.col("event_type"))], None))
    return e.aggregate(q.where(~(P.cmp("t", "=", "view") | P.cmp("t", "=", "click"))), Agg.count("n"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%E%'")
def filter_like(e):
    return e.query(Query("part").where(P.Like("p_type", "%A%E%")).select("p_partkey", "p_type"))


@query("SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%1' AND NOT c_mktsegment ILIKE 'b%'")
def filter_ilike_not(e):
    return e.query(Query("customer").where(P.Like("c_name", "Customer#%1") & ~P.Like("c_mktsegment", "B%", True)).select("c_custkey"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|fr)/[0-9]+$')")
def filter_regex(e):
    return e.query(Query("pages").where(P.Matches("url", r"/(en|fr)/[0-9]+$")).select("page_id", "url"))


@query("SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'was')")
def filter_contains(e):
    return e.query(Query("documents").where(P.Contains("text", "The was!")).select("doc_id"))


@query("SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'license')")
def text_index_search(e):
    return fulltext.search(fulltext.term_index(e.query(Query("documents")), ["doc_id"], "text"), "License", ["doc_id"])


@query("SELECT term, count(*) AS rows FROM (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM benchmark) WHERE term <> '' GROUP BY term")
def term_statistics(e):
    return fulltext.term_statistics(e.query(Query("benchmark")), "text")


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def filter_in(e):
    p = P.isin("o_orderpriority", ["1-URGENT", "2-HIGH"]) & ~P.isin("o_orderstatus", ["F"])
    return e.aggregate(Query("orders").where(p), Agg.count("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def in_subquery(e):
    return e.sql("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_in_subquery(e):
    return e.sql("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")


# --- scalars ---


@query("""SELECT o_orderkey, o_orderkey + 7 AS a, o_orderkey - 9 AS s, o_orderkey * 3 AS m, o_orderkey // 7 AS d,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS z FROM orders""")
def integer_arithmetic(e):
    k = S.col("o_orderkey")
    third = P.columns("rest", "=", "nil")
    q = Query("orders").compute("a", k + 7).compute("s", k - 9).compute("m", k * 3).compute("d", k / 7)
    q = q.compute("nil", S.lit(0)).compute("rest", k - (k / 3) * 3).compute("z", S.case([(third, S.lit(None))], k))
    return e.query(q.select("o_orderkey", "a", "s", "m", "d", "z"))


@query("SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity / 4 AS q, CAST('nan' AS DOUBLE) AS nan FROM lineitem")
def real_arithmetic(e):
    q = Query("lineitem").compute("net", S.col("l_extendedprice") * (S.lit(1) - S.col("l_discount"))).compute("q", S.col("l_quantity") / 4).compute("nan", S.col("l_quantity") / 0.0)
    return rounded(e.query(q.select("l_orderkey", "net", "q", "nan")), "net", to=4)


@query("""SELECT c_custkey, CAST(u + 150 AS BIGINT) AS plus, CAST(u * 3 AS BIGINT) AS times, CAST(trunc(u / 7.0) AS BIGINT) AS part
          FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS u FROM customer)""")
def decimal_arithmetic(e):
    df = e.query(Query("customer").select("c_custkey", "c_acctbal"))
    df = df.select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("decimal(18,0)").alias("u")).select("c_custkey", (F.col("u") / 100).cast(decimal(2).spark()).alias("d"))
    from .schema import table_of

    own = Engine(e.spark).add(table_of("money", df, ["c_custkey"]), df)
    q = Query("money").compute("a", S.col("d") + Decimal("1.50")).compute("b", S.col("d") * 3).compute("c", S.col("d") / 7)
    units = lambda c: (F.col(c) * 100).cast("bigint")
    return own.query(q).select("c_custkey", units("a").alias("plus"), units("b").alias("times"), units("c").alias("part"))


@query("SELECT p_partkey, length(p_name) AS n, upper(p_brand) AS up, p_brand || '-' || p_size AS tag FROM part")
def text_functions(e):
    q = Query("part").compute("n", S.length("p_name")).compute("up", S.upper("p_brand")).compute("tag", S.concat(S.col("p_brand"), "-", S.col("p_size")))
    return e.query(q.select("p_partkey", "n", "up", "tag"))


EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(f"SELECT event_id, {EPOCH} % 60 AS s, ({EPOCH} // 60) % 60 AS m, ({EPOCH} // 3600) % 24 AS h, {EPOCH} // 86400 AS d, {EPOCH} - {EPOCH} % 3600 AS t FROM events")
def time_extract(e):
    q = Query("events")
    for n, u in (("s", "second"), ("m", "minute"), ("h", "hour"), ("d", "day")):
        q = q.compute(n, S.extract(u, "ts"))
    return e.query(q.compute("t", S.date_trunc("hour", "ts")).select("event_id", "s", "m", "h", "d", "t"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) AS w,
          CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS ms, CAST(epoch(date_trunc('year', o_orderdate)) AS BIGINT) AS ys FROM orders""")
def calendar_functions(e):
    q = Query("orders")
    for n, u in (("y", "year"), ("m", "month"), ("d", "day_of_month"), ("w", "day_of_week")):
        q = q.compute(n, S.calendar_part(u, "o_orderdate"))
    q = q.compute("ms", S.calendar_trunc("month", "o_orderdate")).compute("ys", S.calendar_trunc("year", "o_orderdate"))
    return e.query(q.select("o_orderkey", "y", "m", "d", "w", "ms", "ys"))


@query(f"SELECT event_id, {EPOCH} + 32400 AS tokyo, {EPOCH} - 18000 AS fixed FROM events")
def zone_shift(e):
    q = Query("events").compute("tokyo", S.zone_shift("Asia/Tokyo", "ts")).compute("fixed", S.offset("-05:00", "ts"))
    return e.query(q.select("event_id", "tokyo", "fixed"))


@query("SELECT event_id, CAST(round(value) AS BIGINT) AS r FROM events")
def round_function(e):
    return e.query(Query("events").compute("r", S.round_("value")).select("event_id", "r"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size,
          coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders""")
def case_coalesce(e):
    q = Query("orders").compute("size", S.case([(P.cmp("o_totalprice", ">", 200000), "big"), (P.cmp("o_totalprice", ">", 50000), "mid")], "small"))
    q = q.compute("n", S.case([(P.cmp("o_orderstatus", "<>", "O"), S.col("o_orderstatus"))], None)).compute("status", S.coalesce(S.col("n"), "open"))
    return e.query(q.select("o_orderkey", "size", "status"))


VECTOR = [0.1] * 64
_V = "list_transform(range(64), lambda i: CAST(0.1 AS DOUBLE))"


@query(f"""SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), {_V}), 4) AS l2, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), {_V}), 4) AS cos,
           round(-list_inner_product(CAST(embedding AS DOUBLE[]), {_V}), 4) AS nip FROM embeddings""")
def vector_distances(e):
    q = Query("embeddings")
    for n, m in (("l2", "l2"), ("cos", "cosine"), ("nip", "negative_inner_product")):
        q = q.compute(n, S.distance(m, "embedding", VECTOR))
    return rounded(e.query(q.select("vec_id", "l2", "cos", "nip")), "l2", "cos", "nip", to=4)


@query(f"SELECT vec_id, label FROM embeddings WHERE label <> 3 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_V}), vec_id LIMIT 10")
def nearest_neighbours(e):
    q = Query("embeddings").where(P.cmp("label", "<>", 3)).compute("d", S.distance("l2", "embedding", VECTOR)).sort("d").limit(10)
    return e.query(q.select("vec_id", "label"))


@query(r"SELECT page_id, regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1', 'g') AS host FROM pages")
def regexp_replace(e):
    return e.query(Query("pages").compute("host", S.regexp_replace("url", r"^https?://(?:www\.)?([^/]+)/.*$", r"\1")).select("page_id", "host"))


# --- joins ---

_CUSTOMERS, _ORDERS = Query("customer").select("c_custkey", "c_nationkey"), Query("orders").select("o_orderkey", "o_custkey", "o_totalprice")
_WHOLE_SQL = "SELECT c_custkey, c_nationkey, o_orderkey, o_custkey, o_totalprice FROM customer {} JOIN orders ON c_custkey = o_custkey{}"


@query(_WHOLE_SQL.format("", ""))
def join_inner(e):
    return e.join(join(_CUSTOMERS, _ORDERS, [("c_custkey", "o_custkey")]))


@query(_WHOLE_SQL.format("LEFT", ""))
def join_left(e):
    return e.join(join(_CUSTOMERS, _ORDERS, [("c_custkey", "o_custkey")], "left", using="hash"))


@query(_WHOLE_SQL.format("RIGHT", ""))
def join_right(e):
    return e.join(join(_CUSTOMERS, _ORDERS, [("c_custkey", "o_custkey")], "right", using="merge"))


@query(_WHOLE_SQL.format("FULL", ""))
def join_full(e):
    return e.join(join(_CUSTOMERS, _ORDERS, [("c_custkey", "o_custkey")], "full"))


@query(_WHOLE_SQL.format("LEFT", " AND c_nationkey < 10"))
def join_on_residual(e):
    return e.join(join(_CUSTOMERS, _ORDERS, [("c_custkey", "o_custkey")], "left", having=P.cmp("c_nationkey", "<", 10)))


@query("SELECT s_suppkey, s_nationkey, n_nationkey, n_name, s_suppkey + n_nationkey AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_computed(e):
    c = join(Query("supplier").select("s_suppkey", "s_nationkey"), Query("nation").select("n_nationkey", "n_name"), [("s_nationkey", "n_nationkey")], using="nested_loop")
    return e.join(c.compute("total", S.col("s_suppkey") + S.col("n_nationkey")))


@query("SELECT s_suppkey, c_custkey, s_nationkey, c_nationkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def join_two_keys(e):
    c = join(Query("supplier").select("s_suppkey", "s_nationkey"), Query("customer").select("c_custkey", "c_nationkey"), [("s_nationkey", "c_nationkey"), ("s_suppkey", "c_custkey")])
    return e.join(c)


@query("SELECT count(*) AS n FROM (SELECT * FROM customer JOIN orders ON c_custkey = o_custkey OFFSET 10 LIMIT 500)")
def join_limit_offset(e):
    c = join(Query("customer"), Query("orders"), [("c_custkey", "o_custkey")]).offset(10).limit(500)
    return e.join(c).agg(F.count(F.lit(1)).alias("n"))


_CHAIN = (
    Chain(Query("region")).join(Query("nation"), [("r_regionkey", "n_regionkey")]).join(Query("customer"), [("n_nationkey", "c_nationkey")], "left", having=P.cmp("c_acctbal", ">", 9000))
)


@query("""SELECT r_name, n_name, c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000""")
def chain_three(e):
    return e.chain(_CHAIN).select("r_name", "n_name", "c_custkey")


@query("""SELECT 0 AS step, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL
          SELECT 1, count(*) FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000""")
def chain_step_counts(e):
    return e.spark.createDataFrame(list(enumerate(e.step_counts(_CHAIN))), "step int, n bigint")


@query("SELECT a.n_name AS a_n_name, b.n_name AS b_n_name, a.n_regionkey AS a_n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(e):
    c = Chain(Query("nation"), "a").join(Query("nation"), [("a.n_regionkey", "n_regionkey")], alias="b")
    return e.chain(c).select("a_n_name", "b_n_name", "a_n_regionkey")


@query("SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) JOIN (SELECT nullif(s_nationkey, 3) AS k2 FROM supplier) ON k = k2")
def join_null_keys(e):
    null3 = lambda c: S.case([(P.cmp(c, "<>", 3), S.col(c))], None)
    c = join(Query("customer").compute("k", null3("c_nationkey")), Query("supplier").compute("k2", null3("s_nationkey")), [("k", "k2")])
    return e.join(c).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, CAST(count(s_suppkey) AS BIGINT) AS n, sum(s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL) AS keys FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1".replace("sum(s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL)", "CAST(coalesce(sum(s_suppkey), 0) AS BIGINT)"))
def related_has_many(e):
    df = load_related(e.query(Query("nation")), e.query(Query("supplier")), [("n_nationkey", "s_nationkey")], "suppliers", ["s_suppkey"])
    return df.select("n_nationkey", F.size("suppliers").cast("bigint").alias("n"), F.aggregate("suppliers", F.lit(0).cast("bigint"), lambda a, x: a + x["s_suppkey"]).alias("keys"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def related_belongs_to(e):
    return load_one_related(e.query(Query("supplier")), e.query(Query("nation")), [("s_nationkey", "n_nationkey")], "nation").select("s_suppkey", "nation.n_name")


@query("SELECT c_custkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM customer LEFT JOIN (SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) ON c_custkey = o_custkey GROUP BY 1")
def related_through(e):
    links = e.join(join(Query("orders").select("o_orderkey", "o_custkey"), Query("lineitem").select("l_orderkey", "l_partkey"), [("o_orderkey", "l_orderkey")]))
    df = load_through(e.query(Query("customer")), links, e.query(Query("part").select("p_partkey", "p_name")), ("c_custkey", "o_custkey"), ("l_partkey", "p_partkey"), "parts", ["p_partkey"])
    return df.select("c_custkey", F.size("parts").cast("bigint").alias("parts"))


@query("SELECT r_regionkey, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS nations, CAST(count(s_suppkey) AS BIGINT) AS suppliers FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def related_nested(e):
    levels = [(e.query(Query("nation")), [("r_regionkey", "n_regionkey")], "nations", ["n_nationkey"]), (e.query(Query("supplier")), [("n_nationkey", "s_nationkey")], "suppliers", ["s_suppkey"])]
    df = load_nested(levels, e.query(Query("region")))
    total = F.aggregate("nations", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["suppliers"]))
    return df.select("r_regionkey", F.size("nations").cast("bigint").alias("nations"), total.alias("suppliers"))


# --- aggregates ---


@query("""SELECT count(*) AS n, count(nullif(l_returnflag, 'R')) AS k, min(l_shipdate_s) AS lo, max(l_returnflag) AS hi, CAST(sum(l_partkey) AS BIGINT) AS s,
          round(avg(l_quantity), 6) AS a, count(DISTINCT l_suppkey) AS d FROM (SELECT *, CAST(epoch(l_shipdate) AS BIGINT) AS l_shipdate_s FROM lineitem)""")
def aggregate_all(e):
    q = Query("lineitem").compute("f", S.case([(P.cmp("l_returnflag", "<>", "R"), S.col("l_returnflag"))], None))
    aggs = [Agg.count("n"), Agg.count_column("f", "k"), Agg.min("l_shipdate", "lo"), Agg.max("l_returnflag", "hi"), Agg.sum("l_partkey", "s"), Agg.avg("l_quantity", "a"), Agg.count_distinct("l_suppkey", "d")]
    return rounded(e.aggregate(q, *aggs), "a", to=6)


@query("SELECT count(*) AS n FROM events WHERE value > 1e18")
def aggregate_empty(e):
    return e.aggregate(Query("events").where(P.cmp("value", ">", 1e18)), Agg.count("n"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(e):
    q = Query("lineitem").where(P.cmp("l_shipdate", "<=", 904694400)).compute("net", S.col("l_extendedprice") * (S.lit(1) - S.col("l_discount")))
    g = Grouping().group_by("l_returnflag", "l_linestatus").aggregate(Agg.sum("l_quantity", "qty"), Agg.sum("net", "revenue"), Agg.avg("l_discount", "disc"), Agg.count("n"))
    return rounded(rounded(e.grouped(q, g), "qty", "revenue"), "disc", to=6)


@query(f"SELECT {EPOCH} - {EPOCH} % 86400 AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def group_by_computed(e):
    g = Grouping().group_by("day", "event_type").aggregate(Agg.count("n"), Agg.count_distinct("user_id", "users"))
    return e.grouped(Query("events").compute("day", S.date_trunc("day", "ts")), g)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND min(o_totalprice) > 1000 ORDER BY n DESC, o_custkey LIMIT 20 OFFSET 3".replace("SELECT o_custkey, count(*) AS n", "SELECT o_custkey, count(*) AS n, min(o_totalprice) AS low"))
def group_having_order_limit(e):
    g = Grouping().group_by("o_custkey").aggregate(Agg.count("n"), Agg.min("o_totalprice", "low")).having(P.cmp("n", ">", 12) & P.cmp("low", ">", 1000))
    return e.grouped(Query("orders"), g.sort(desc("n"), "o_custkey").limit(20).offset(3))


@query("SELECT t, count(*) AS n FROM (SELECT nullif(event_type, 'click') AS t FROM events) GROUP BY 1")
def group_null_key(e):
    q = Query("events").compute("t", S.case([(P.cmp("event_type", "<>", "click"), S.col("event_type"))], None)).sort("t").limit(1)
    return e.grouped(q, Grouping().group_by("t").aggregate(Agg.count("n")))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 2 ORDER BY n DESC, n_name LIMIT 3")
def grouped_join(e):
    c = join(Query("customer"), Query("nation"), [("c_nationkey", "n_nationkey")])
    return e.grouped_join(c, Grouping().group_by("n_name").aggregate(Agg.count("n")).having(P.cmp("n", ">", 2)).sort(desc("n"), "n_name").limit(3))


@query("""SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM region JOIN nation ON r_regionkey = n_regionkey
          JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def grouped_chain(e):
    c = Chain(Query("region")).join(Query("nation"), [("r_regionkey", "n_regionkey")]).join(Query("customer"), [("n_nationkey", "c_nationkey")])
    c = c.join(Query("orders"), [("c_custkey", "o_custkey")]).join(Query("lineitem"), [("o_orderkey", "l_orderkey")])
    c = c.compute("net", S.col("l_extendedprice") * (S.lit(1) - S.col("l_discount")))
    return rounded(e.grouped_chain(c, Grouping().group_by("r_name").aggregate(Agg.count("n"), Agg.sum("net", "revenue"))), "revenue", to=1)


# --- windows ---


@query("""SELECT event_id, row_number() OVER w AS rn, rank() OVER r AS rk, dense_rank() OVER r AS dr FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts_s, event_id), r AS (PARTITION BY user_id ORDER BY event_type)""".replace("FROM events", f"FROM (SELECT *, {EPOCH} AS ts_s FROM events)"))
def window_ranking(e):
    q = Query("events").window(Window.row_number("rn").over(["user_id"], ["ts"]))
    q = q.window(Window.rank("rk").over(["user_id"], ["event_type"])).window(Window.dense_rank("dr").over(["user_id"], ["event_type"]))
    return e.query(q.select("event_id", "rn", "rk", "dr"))


@query("SELECT conv_id, turn, lag(role) OVER w AS before, lead(role, 2) OVER w AS after2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def window_lag_lead(e):
    w = (["conv_id"], ["turn"])
    q = Query("conversations").window(Window.lag("before", "role").over(*w)).window(Window.lead("after2", "role", 2).over(*w))
    return e.query(q.select("conv_id", "turn", "before", "after2"))


@query("""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, CAST(d AS BIGINT) AS kinds,
          CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS running
          FROM orders JOIN (SELECT o_custkey AS k, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY 1) ON o_custkey = k""")
def window_aggregates(e):
    q = Query("orders").window(Window.aggregate(Agg.count("n")).over(["o_custkey"])).window(Window.aggregate(Agg.count_distinct("o_orderstatus", "kinds")).over(["o_custkey"]))
    return e.query(q.window(Window.aggregate(Agg.sum("o_orderkey", "running")).over(["o_custkey"], ["o_orderpriority"])).select("o_orderkey", "n", "kinds", "running"))


@query("SELECT o_orderkey, rk FROM (SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS rk FROM orders) ORDER BY rk, o_orderkey LIMIT 25")
def window_then_limit(e):
    q = Query("orders").window(Window.rank("rk").over(["o_orderpriority"], [desc("o_totalprice")])).sort("rk").limit(25)
    return e.query(q.select("o_orderkey", "rk"))


@query("""SELECT event_id, row_number() OVER (ORDER BY t ASC NULLS FIRST, event_id) AS up FROM (SELECT event_id, nullif(event_type, 'click') AS t FROM events)""")
def window_null_order(e):
    q = Query("events").compute("t", S.case([(P.cmp("event_type", "<>", "click"), S.col("event_type"))], None))
    return e.query(q.window(Window.row_number("up").over([], ["t"])).select("event_id", "up"))


# --- order, limit, pages ---


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 15 OFFSET 5")
def order_limit_offset(e):
    return e.query(Query("part").sort(desc("p_size"), asc("p_retailprice")).limit(15).offset(5).select("p_partkey", "p_size", "p_retailprice"))


@query("SELECT event_id FROM (SELECT event_id, nullif(event_type, 'click') AS t FROM events) ORDER BY t DESC NULLS FIRST, event_id LIMIT 12")
def order_nulls_first(e):
    q = Query("events").compute("t", S.case([(P.cmp("event_type", "<>", "click"), S.col("event_type"))], None))
    return e.query(q.sort(desc("t", "first")).limit(12).select("event_id"))


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (10, 1) ORDER BY conv_id, turn LIMIT 20")
def keyset_page(e):
    return e.query(Query("conversations").after(10, 1).limit(20).select("conv_id", "turn", "role"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey > 50 ORDER BY c_custkey LIMIT 10) LEFT JOIN orders ON c_custkey = o_custkey")
def paged_join(e):
    c = join(Query("customer").after(50).limit(10), Query("orders"), [("c_custkey", "o_custkey")], "left").paging()
    return e.join(c).select("c_custkey", "o_orderkey")


@query("SELECT n_name, s_suppkey, c_custkey FROM (SELECT * FROM nation WHERE n_nationkey > 3 ORDER BY n_nationkey LIMIT 4) JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON s_suppkey = c_custkey")
def paged_chain(e):
    c = Chain(Query("nation").after(3).limit(4)).join(Query("supplier"), [("n_nationkey", "s_nationkey")]).join(Query("customer"), [("s_suppkey", "c_custkey")]).paging()
    return e.chain(c).select("n_name", "s_suppkey", "c_custkey")


# --- SQL subset ---

_SQL = {
    "sql_select": ("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY') ORDER BY c_custkey LIMIT 30", None),
    "sql_cte": ("WITH rich AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 8000) SELECT c_nationkey, count(*) AS n FROM rich WHERE c_custkey > 10 GROUP BY c_nationkey", None),
    "sql_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "sql_having": ("SELECT l_suppkey, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20 ORDER BY count(*) DESC, l_suppkey LIMIT 10", None),
    "sql_join": ("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name", None),
    "sql_chain": ("SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY r_name", None),
    "sql_self_join": ("SELECT b.n_name, count(*) AS n FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey GROUP BY b.n_name", 'SELECT b.n_name AS "b.n_name", count(*) AS n FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey GROUP BY b.n_name'),
    "sql_window": ("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS rk FROM orders", None),
    "sql_calls": (
        "SELECT hour(ts) AS h, day_of_week(ts) AS w, count(*) AS n FROM events GROUP BY hour(ts) AS h, day_of_week(ts) AS w",
        "SELECT CAST(hour(ts) AS BIGINT) AS h, CAST(dayofweek(ts) AS BIGINT) AS w, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "sql_zone": (
        "SELECT event_id, day(ts, 'Asia/Kolkata') AS d, month_start(ts, '-05:00') AS m FROM events",
        "SELECT event_id, day(ts + INTERVAL 330 MINUTE) AS d, CAST(epoch(date_trunc('month', ts - INTERVAL 5 HOUR)) AS BIGINT) AS m FROM events",
    ),
    "sql_like_regex": ("SELECT page_id FROM pages WHERE url LIKE 'https%' AND url ~ '[0-9]{3}' AND url ILIKE '%EXAMPLE%'", "SELECT page_id FROM pages WHERE url LIKE 'https%' AND regexp_matches(url, '[0-9]{3}') AND url ILIKE '%EXAMPLE%'"),
    "sql_contains": ("SELECT doc_id FROM documents WHERE text CONTAINS 'rights reserved'", r"SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'rights') AND list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'reserved')"),
}
for _name, (_text, _oracle) in _SQL.items():
    QUERIES[_name] = lambda spark, sf_dir, _text=_text: engine(spark, sf_dir).sql(_text)
    SQL[_name] = _oracle or _text


# --- security ---


def _secured() -> tuple[Security, Context]:
    s = Security().grant("analyst", "orders", READ).grant("analyst", "customer", READ, INSERT, UPDATE, DELETE)
    s.policy(Policy("orders", lambda ctx: P.cmp("o_orderstatus", "=", "F")), Policy("orders", lambda ctx: P.cmp("o_custkey", "=", ctx.principal)))
    s.columns[("analyst", "customer")] = {"c_custkey", "c_name", "c_nationkey"}
    return s, Context(principal=7, roles=("analyst",))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_custkey = 7 GROUP BY 1")
def row_policy_group(e):
    e.security, ctx = _secured()
    return e.grouped(Query("orders"), Grouping().group_by("o_orderpriority").aggregate(Agg.count("n")), ctx)


@query("SELECT c_custkey, c_name, c_nationkey, o_orderkey FROM customer JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' OR o_custkey = 7) ON c_custkey = o_custkey")
def column_grant_join(e):
    e.security, ctx = _secured()
    return e.join(join(Query("customer"), Query("orders").select("o_orderkey", "o_custkey"), [("c_custkey", "o_custkey")]), ctx).drop("o_custkey")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 5", conversations={"tenant": "conv_id"})
def tenant_read(e):
    e.security.grant("member", "conversations", READ)
    return e.query(Query("conversations").select("conv_id", "turn", "role"), Context(roles=("member",), tenant=5))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def view_read(e):
    e.add_view("debtors", "customer", P.cmp("c_acctbal", "<", 0))
    return e.query(Query("debtors").where(P.cmp("c_mktsegment", "=", "BUILDING")).select("c_custkey", "c_acctbal"))


# --- introspection, sources, writes ---


@query("SELECT count(*) AS rows, count(DISTINCT c_mktsegment) AS distinct, CAST(0 AS BIGINT) AS nulls, min(c_mktsegment) AS low, max(c_mktsegment) AS high FROM customer".replace("AS distinct", "AS kinds"))
def analyze_table(e):
    t = e.analyze("customer", ["c_mktsegment"])
    c = t.columns["c_mktsegment"]
    return e.spark.createDataFrame([(t.rows, c.distinct, c.nulls, c.low, c.high)], "rows bigint, kinds bigint, nulls bigint, low string, high string")


_DML = {
    "write_insert": (lambda w: w.insert("nation", [{"n_nationkey": 90, "n_name": "ATLANTIS", "n_regionkey": 1}]), "SELECT * FROM nation UNION ALL SELECT 90, 'ATLANTIS', 1"),
    "write_update_where": (lambda w: w.update_where("nation", P.cmp("n_regionkey", "=", 2), [("n_name", S.upper(S.concat(S.col("n_name"), "-x")))]), "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name || '-x') ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "write_delete_where": (lambda w: w.delete_where("nation", P.cmp("n_nationkey", ">=", 20)), "SELECT * FROM nation WHERE n_nationkey < 20"),
    "write_delete": (lambda w: w.delete("nation", [(3,), (4,)]), "SELECT * FROM nation WHERE n_nationkey NOT IN (3, 4)"),
    "write_upsert": (lambda w: w.upsert("nation", [{"n_nationkey": 1, "n_name": "ONE", "n_regionkey": 0}, {"n_nationkey": 91, "n_name": "NEW", "n_regionkey": 4}]), "SELECT * FROM nation WHERE n_nationkey <> 1 UNION ALL VALUES (1, 'ONE', 0), (91, 'NEW', 4)"),
    "write_batch": (lambda w: w.batch([("insert", ("nation", [{"n_nationkey": 92, "n_name": "A", "n_regionkey": 0}])), ("delete", ("nation", [(92,)])), ("delete", ("nation", [(0,)]))]), "SELECT * FROM nation WHERE n_nationkey <> 0"),
}


def _written(change):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.add_parquet("nation", f"{sf_dir}/nation.parquet", ["n_nationkey"])
        change(e.writer())
        return e.query(Query("nation")).select("n_nationkey", "n_name", "n_regionkey")

    return run


for _name, (_change, _oracle) in _DML.items():
    QUERIES[_name] = _written(_change)
    SQL[_name] = f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM ({_oracle})"


def bench_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """What ``bench.py`` times: the shapes of log analytics."""
    from .bench_shapes import SHAPES

    return {k: (lambda spark, sf_dir, q=q: q(engine(spark, sf_dir))) for k, q in SHAPES.items()}


from . import queries_kept  # noqa: E402, F401 - registers its queries here
