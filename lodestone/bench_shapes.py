"""The shapes of log-analytics queries, over the driver's tables."""

from __future__ import annotations

from .functions import P, S
from .plans.spec import Agg, Grouping, Query, desc

L, E, O, D, G = (Query(t) for t in ("lineitem", "events", "orders", "documents", "pages"))
_top = lambda g, n=10: g.sort(desc("n"), *g.keys).limit(n)
_n = Agg.count("n")


def _group(q: Query, *keys: str, aggs: tuple = (), n: int | None = 10):
    g = Grouping().group_by(*keys).aggregate(_n, *aggs)
    return lambda e: e.grouped(q, _top(g, n) if n else g)


def _agg(q: Query, *aggs: Agg):
    return lambda e: e.aggregate(q, *aggs)


def _host(q: Query) -> Query:
    return q.compute("host", S.regexp_replace("url", r"^https?://(?:www\.)?([^/]+)/.*$", r"\1"))


def _widths(n: int):
    q = L
    for i in range(n):
        q = q.compute(f"w{i}", S.col("l_linenumber") + i)
    return _agg(q, *[Agg.sum(f"w{i}", f"s{i}") for i in range(n)])


_july = (P.cmp("l_shipdate", ">=", 804556800)) & (P.cmp("l_shipdate", "<", 836179200))
_sums = (Agg.sum("l_linenumber", "s"), Agg.avg("l_quantity", "a"))
_minute = E.compute("minute", S.date_trunc("minute", "ts"))

SHAPES = {
    "q1_count": _agg(L, _n),
    "q2_count_filtered": _agg(L.where(P.cmp("l_discount", "<>", 0.0)), _n),
    "q3_sum_count_avg": _agg(L, Agg.sum("l_partkey", "s"), _n, Agg.avg("l_quantity", "a")),
    "q4_avg": _agg(L, Agg.avg("l_orderkey", "a")),
    "q5_distinct_numbers": _agg(L, Agg.count_distinct("l_orderkey", "d")),
    "q6_distinct_texts": _agg(D, Agg.count_distinct("text", "d")),
    "q7_min_max": _agg(L, Agg.min("l_shipdate", "lo"), Agg.max("l_shipdate", "hi")),
    "q8_few_groups": _group(L, "l_returnflag", n=None),
    "q9_distinct_per_group": _group(L, "l_suppkey", aggs=(Agg.count_distinct("l_partkey", "d"),)),
    "q10_five_aggregates": _group(L, "l_suppkey", aggs=(Agg.sum("l_partkey", "s"), Agg.avg("l_quantity", "a"), Agg.count_distinct("l_orderkey", "d"))),
    "q11_distinct_per_text": _group(E.where(P.cmp("event_type", "<>", "")), "event_type", aggs=(Agg.count_distinct("user_id", "u"),)),
    "q12_distinct_per_two": _group(E.where(P.cmp("event_type", "<>", "")).compute("k", S.date_trunc("day", "ts")), "k", "event_type", aggs=(Agg.count_distinct("user_id", "u"),)),
    "q13_group_text": _group(E.where(P.cmp("props", "<>", "")), "props"),
    "q14_group_text_distinct": _group(E.where(P.cmp("props", "<>", "")), "props", aggs=(Agg.count_distinct("user_id", "u"),)),
    "q15_group_two": _group(L, "l_partkey", "l_returnflag"),
    "q16_group_many": _group(L, "l_orderkey"),
    "q17_group_pairs": _group(L, "l_orderkey", "l_suppkey"),
    "q18_pairs_any_ten": lambda e: e.grouped(L, Grouping().group_by("l_orderkey", "l_suppkey").aggregate(_n).limit(10)),
    "q19_minute_in_key": _group(E.compute("m", S.extract("minute", "ts")), "user_id", "m", "event_type"),
    "q20_point": lambda e: e.get("orders", 12345),
    "q21_like": _agg(D.where(P.Like("text", "%tion of%")), _n),
    "q22_like_group": _group(G.where(P.Like("url", "%example%")), "url"),
    "q23_two_likes": _group(_host(G.where(P.Like("url", "%example%") & ~P.Like("url", "%.net%"))), "host"),
    "q24_wide_top": lambda e: e.query(D.where(P.Like("text", "%license%")).sort("n_chars").limit(10)),
    "q25_top": lambda e: e.query(E.sort("ts").limit(10)),
    "q26_top_text": lambda e: e.query(E.where(P.cmp("props", "<>", "")).sort("props").limit(10).select("props")),
    "q27_top_two_keys": lambda e: e.query(L.sort("l_shipdate", "l_extendedprice").limit(10)),
    "q28_length_having": lambda e: e.grouped(D.compute("len", S.length("text")), Grouping().group_by("source").aggregate(_n, Agg.avg("len", "a")).having(P.cmp("n", ">", 100)).sort(desc("a"))),
    "q29_host_having": lambda e: e.grouped(_host(G), Grouping().group_by("host").aggregate(_n).having(P.cmp("n", ">", 5)).sort(desc("n"), "host")),
    "q30_ninety_sums": _widths(90),
    "q31_filtered_pairs": _group(L.where(P.cmp("l_returnflag", "<>", "")), "l_suppkey", "l_partkey", aggs=_sums),
    "q32_filtered_keys": _group(L.where(P.cmp("l_returnflag", "<>", "")), "l_orderkey", "l_partkey", aggs=_sums),
    "q33_all_groups": _group(L, "l_orderkey", "l_linenumber", "l_partkey"),
    "q34_group_url": _group(G, "url"),
    "q35_literal_and_text": _group(G.compute("one", S.lit(1)), "one", "url"),
    "q36_derived_keys": _group(L.compute("k1", S.col("l_partkey") - 1).compute("k2", S.col("l_partkey") - 2).compute("k3", S.col("l_partkey") - 3), "l_partkey", "k1", "k2", "k3"),
    "q37_dates_group": _group(L.where(_july), "l_partkey"),
    "q38_dates_text": _group(L.where(_july & P.cmp("l_returnflag", "<>", "")), "l_returnflag", "l_partkey"),
    "q39_offset": lambda e: e.grouped(L.where(_july), Grouping().group_by("l_suppkey").aggregate(_n).sort(desc("n"), "l_suppkey").limit(10).offset(50)),
    "q40_case_key": _group(L.where(_july).compute("src", S.case([(P.cmp("l_returnflag", "=", "R"), S.col("l_linestatus"))], "")), "src", "l_suppkey"),
    "q41_in": _group(L.where(_july & P.isin("l_linenumber", [1, 6])), "l_partkey"),
    "q42_offset_pairs": lambda e: e.grouped(L.where(_july), Grouping().group_by("l_suppkey", "l_linenumber").aggregate(_n).sort(desc("n"), "l_suppkey", "l_linenumber").limit(10).offset(1000)),
    "q43_minutes": _group(_minute, "minute"),
}
