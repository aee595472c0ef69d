"""Scalars, predicates, patterns, full text: golden values and refusals."""

import math
from decimal import Decimal

import pytest


from lodestone.errors import DecimalScale, InListTooLarge, NoSuchColumn, Refused, TypeMismatch
from lodestone.functions import P, S, patterns, text
from lodestone.functions.predicates import implies
from lodestone.plans.lower import filtered, scope_of


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame(
        [(7, 1 << 62, 0.0, "x", None, [3.0, 4.0], Decimal("12.50"))],
        "n bigint, big bigint, z double, s string, nul bigint, v array<float>, d decimal(18,2)",
    )


def value(df, scalar):
    return df.select(scalar.column(scope_of(df)).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: S.col("n") + 1, 8), (lambda: S.col("n") + S.col("nul"), None), (lambda: S.col("n") + "x", None), (lambda: S.col("n") / 0, None),
        (lambda: S.col("big") + S.col("big"), None), (lambda: S.lit(3) + 0.5, 3.5), (lambda: S.lit(-7) / 2, -3), (lambda: S.lit(S.MIN64) / -1, None), (lambda: S.col("big") * 4, None),
        (lambda: S.length("s"), 1), (lambda: S.length("n"), None), (lambda: S.concat(S.col("s"), 1.0, S.col("n")), "x17"), (lambda: S.concat(S.col("s"), S.col("nul")), None),
        (lambda: S.upper(S.lit("ß")), "SS"), (lambda: S.round_(S.lit(2.5)), 3), (lambda: S.round_(S.lit(-2.5)), -3), (lambda: S.round_(S.lit(1e300)), S.MAX64), (lambda: S.round_(S.lit(math.nan)), None),
        (lambda: S.coalesce(S.col("nul"), 4), 4), (lambda: S.case([(P.cmp("nul", "=", 1), "a")], "b"), "b"),
        (lambda: S.col("d") + Decimal("0.25"), Decimal("12.75")), (lambda: S.col("d") / 3, Decimal("4.16")), (lambda: S.col("d") * 2, Decimal("25.00")), (lambda: S.col("d") / 0, None), (lambda: S.col("d") * S.col("big"), None),
    ],
)
def test_scalars(one, make, want):
    assert value(one, make()) == want


def test_real_division_by_zero_is_nan(one):
    assert math.isnan(value(one, S.lit(1.0) / S.col("z"))) and math.isnan(value(one, S.col("z") / S.col("z")))


@pytest.mark.parametrize(
    ("seconds", "parts"),
    [(0, (1970, 1, 1, 4)), (-1, (1969, 12, 31, 3)), (-86401, (1969, 12, 30, 2)), (1704067200, (2024, 1, 1, 1)), (1709164800, (2024, 2, 29, 4)), (951782400, (2000, 2, 29, 2)), (-2203977600, (1900, 2, 28, 3)), (-2203891200, (1900, 3, 1, 4))],
)
def test_calendar(one, seconds, parts):
    names = ("year", "month", "day_of_month", "day_of_week")
    assert tuple(value(one, S.calendar_part(n, S.lit(seconds))) for n in names) == parts


def test_time(one):
    assert [value(one, S.calendar_trunc(u, S.lit(t))) for t in (1709214300, -1, -2203977600) for u in ("month", "year")] == [1706745600, 1704067200, -2678400, -31536000, -2206310400, -2208988800]
    assert value(one, S.date_trunc("minute", S.lit(-30))) == -60 and value(one, S.extract("second", S.lit(-30))) == 30 and value(one, S.extract("day", S.lit(-30))) == -1
    assert value(one, S.zone_shift("Asia/Kolkata", S.lit(0))) == 19800 and value(one, S.zone_shift("Nowhere/At_All", S.lit(0))) is None
    assert value(one, S.offset("-05:00", S.lit(0))) == -18000
    with pytest.raises(Refused):
        S.offset("5", S.lit(0))


def test_distances(one):
    d = lambda m, b: value(one, S.distance(m, "v", b))
    assert d("l2", [0, 0]) == 5 and d("l2_squared", [0, 0]) == 25 and d("negative_inner_product", [3, 4]) == -25
    assert d("cosine", [-4, 3]) == pytest.approx(1) and d("cosine", [-3, -4]) == pytest.approx(2) and d("cosine", [6, 8]) == pytest.approx(0)
    assert d("l2", [1]) is None and d("cosine", [0, 0]) is None
    with pytest.raises(Refused):
        d("hamming", [1, 2])


@pytest.mark.parametrize(
    "make",
    [lambda: S.col("d") * S.col("d"), lambda: S.lit(1) / S.col("d"), lambda: S.col("d") + 0.5, lambda: S.col("d") + Decimal("0.001"), lambda: S.round_("d"), lambda: S.length("d"), lambda: S.col("d") + S.col("n"),
     lambda: S.case([(P.TRUE, S.col("d"))], S.col("n"))],
)
def test_decimal_refusals(one, make):
    with pytest.raises(DecimalScale):
        make().kind(scope_of(one))


def test_regexp_replace(spark):
    df = spark.createDataFrame([("http://google.com/a",), ("https://www.example.org/x/y",), ("none",), ("a1b22",)], "s string")
    out = lambda p, r: [x[0] for x in df.select(S.regexp_replace("s", p, r).column(scope_of(df))).collect()]
    assert out(r"^https?://(?:www\.)?([^/]+)/.*$", r"\1") == ["google.com", "example.org", "none", "a1b22"]
    assert out("((", "x") == [None] * 4 and out(r"(\d+)", r"[\1]")[3] == "a[1]b[22]" and out("a", "$")[3] == "$1b22"


def test_three_valued_logic(spark):
    df = spark.createDataFrame([(1, "Ab", None), (2, "b\nc", 5), (3, None, 7)], "k bigint, s string, n bigint")
    ks = lambda p: [r.k for r in filtered(df, p).orderBy("k").collect()]
    assert ks(P.Like("s", "a%", True)) == [1] and ks(~P.Like("s", "a%", True)) == [2]
    assert ks(P.Matches("s", "B", True)) == [1, 2] and ks(~P.Matches("s", "zz")) == [1, 2] and ks(~P.Matches("s", "((")) == [1, 2]
    assert ks(P.Matches("s", "b$")) == [1] and ks(P.Like("s", "b%c")) == [2]
    assert ks(P.isin("n", [5, None])) == [2] and ks(~P.isin("n", [5, None])) == [] and ks(~P.isin("n", [5])) == [3]
    assert ks(P.cmp("n", "<>", 5)) == [3] and ks(P.is_null("n")) == [1] and ks(P.not_null("n") & P.TRUE) == [2, 3] and ks(P.FALSE | P.cmp("k", ">=", 3)) == [3]
    with pytest.raises(TypeMismatch):
        ks(P.cmp("k", "=", "1"))
    with pytest.raises(TypeMismatch):
        ks(P.columns("k", "=", "s"))
    with pytest.raises(NoSuchColumn):
        ks(P.cmp("nope", "=", 1))
    with pytest.raises(InListTooLarge):
        ks(P.isin("k", range(10_001)))


def test_like_escapes():
    assert patterns.like(r"a\%b\_c\\") == r"a\%b\_c\\" and patterns.like(r"\a") == "a" and patterns.like("end\\") == "end\\\\"
    assert patterns.regex("(?=a)") is None and patterns.regex(r"(a)\1") is None and patterns.regex("a++") is None and patterns.regex("a$").endswith("a\\z")


def test_full_text(spark):
    rows = [(1, "A Wizard of Earthsea", "the first"), (2, "The Left Hand of Darkness", "the second"), (3, "The Dispossessed", None), (4, "A Wizard of Oz", "the fourth"), (5, "Solaris--Second,Edition", "the fifth")]
    df = spark.createDataFrame(rows, "id bigint, title string, body string")
    index = text.term_index(df, ["id"], "title")
    for q, want in (("wizard", [1, 4]), ("wizard earthsea", [1]), ("WIZARD, of!", [1, 4]), ("dragons", []), ("wiz", []), ("solaris", [5]), ("edition", [5]), ("???", [])):
        assert [r.id for r in filtered(df, P.Contains("title", q)).orderBy("id").collect()] == want
        assert [r.id for r in text.search(index, q, ["id"]).orderBy("id").collect()] == want
    assert [r.id for r in filtered(df, ~P.Contains("body", "first")).orderBy("id").collect()] == [2, 4, 5]


@pytest.mark.parametrize(("raw", "want"), [("Ursula K. Le Guin", ["guin", "k", "le", "ursula"]), ("a--b, c!!!", ["a", "b", "c"]), ("Model K9 rev2", ["k9", "model", "rev2"]), ("Война и мир", ["война", "и", "мир"]), ("!!!", [])])
def test_tokenizer(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.tokens(df["s"])).first()[0] == want == text.terms(raw)


def test_implication():
    a = P.cmp("x", ">", 10)
    assert implies(a, P.cmp("x", ">", 5)) and implies(a, P.cmp("x", ">=", 10)) and implies(a, P.cmp("x", "<>", 10)) and implies(a, P.not_null("x")) and implies(P.FALSE, a) and implies(a, P.TRUE)
    assert not implies(a, P.cmp("x", ">", 11)) and not implies(a, P.cmp("y", ">", 5)) and not implies(P.TRUE, a)
    assert implies(P.isin("x", [11, 12]), a) and not implies(P.isin("x", [1, 12]), a) and implies(a & P.cmp("y", "=", 1), a) and implies(a, a | P.cmp("y", "=", 1))
    assert implies(P.cmp("x", "=", 11) | P.cmp("x", "=", 12), a) and not implies(P.cmp("x", "=", 11) | P.cmp("y", "=", 1), a)


def test_arrays_order(spark):
    df = spark.createDataFrame([([2],), ([1, 2],), ([],), ([1],)], "a array<bigint>")
    assert [r.a for r in df.orderBy("a").collect()] == [[], [1], [1, 2], [2]]
