"""Quality rules: a learned decision list over statistics of each text.

Sequential covering: while rows of the bad class are left, a rule is grown by
adding the threshold condition with the best information gain, pruned on rows
held back, and kept if it is precise enough there. Every step is one aggregate
over the labelled statistics, whose result has one row for each feature and
bin, so only such bounded tables reach the driver. The rules become ordered
Spark conditional expressions; no Python runs on the executors.

Defined results: a null text counts as empty; an empty text has zero words and
fails the base rule; repeated rows are judged one by one; extra columns are
carried through by ``filter_documents`` and ignored by ``judge``; an empty
table gives an empty result; without usable labels the list has no rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CHAR, Stored, labelled_sample, once, whole_row, word_array

#: Character class of what counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Quantiles at which a feature may be cut.
CUTS = [i / 20 for i in range(1, 20)] + [0.01, 0.02, 0.03, 0.07, 0.93, 0.97, 0.98, 0.99]


def _chars(c: Column, which: str) -> Column:
    """How many characters of ``c`` are in the class ``which``."""
    other = which[1:] if which[0] == "^" else f"^{which}"
    return F.char_length(F.regexp_replace(c, f"[{other}]+", "")).cast("long")


def _repeat_words(words: str, hashes: str) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    The windows are sorted by hash, so that equal ones are neighbours, and the
    places found are merged in order: n log n in the words of a text."""
    n = F.size(words)
    ranked = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the sort is bound as a lambda variable, so that it is computed once
    places = F.transform(
        F.array(ranked),
        lambda r: F.sort_array(
            F.transform(
                F.filter(r, lambda x, j: (F.get(r, j - 1)["h"] == x["h"]) | (F.get(r, j + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        ),
    )
    merged = F.aggregate(
        F.flatten(places),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("free")),
        lambda acc, p: F.struct(
            (acc["n"] + (p + 3 - F.greatest(p, acc["free"]))).cast("long").alias("n"), (p + 3).alias("free")
        ),
        lambda acc: acc["n"],
    )
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when((n >= 3) & some, merged).otherwise(F.lit(0).cast("long"))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_s``, a struct of statistics of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = once(docs, "_w", word_array(F.col(text)))
    n = F.size("_w")
    out = once(
        out,
        "_h",
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
            )
        ),
    )
    out = once(out, "_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR)))
    stats = F.struct(
        n.cast("long").alias("n_words"),
        _chars(t, r"^\x20\x09-\x0D").alias("word_chars"),
        _chars(t, SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words("_w", "_h").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        _chars(t, "A-Z").alias("n_upper"),
        _chars(t, "0-9").alias("n_digits"),
        _chars(t, "!?").alias("n_shouts"),
    )
    return once(out, "_s", stats).drop("_w", "_h", "_l")


def features(s: str = "_s") -> dict[str, Column]:
    """Ratios, as doubles, that rules may cut; defined for empty texts too."""
    c = lambda name: F.col(f"{s}.{name}").cast("double")
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    return {
        "n_words": c("n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "distinct_ratio": per("n_distinct", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
        "digit_ratio": per("n_digits", "word_chars"),
        "shout_ratio": per("n_shouts", "n_words"),
    }


def base_failed(s: str = "_s") -> Column:
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # else: at most
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        c = of[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order; a row that fits one is bad, any other is good."""

    rules: list[list[Condition]] = field(default_factory=list)

    def bad(self, of: dict[str, Column]) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(_all(rule, of), F.lit(True)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, r))}: reject" for r in self.rules) + "\nelse: keep"


def _all(rule: list[Condition], of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(of)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's gain of narrowing p0 bad and n0 good rows to p and n."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of ``cuts`` lie below ``value``."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < value))


def learn(rows: DataFrame, names: list[str], max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, least: int = 5) -> DecisionList:
    """Learn a list from ``rows``: one double column for each of ``names``, a
    boolean ``bad`` and an integer ``fold`` (0 prunes, others grow)."""
    of = {k: F.col(k) for k in names}
    cuts = rows.agg(*[F.percentile_approx(k, CUTS, 10000).alias(k) for k in names]).first()
    grid = {k: sorted(set(cuts[k] or [])) for k in names}
    learned = DecisionList()
    if not any(grid.values()):
        return learned
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), _bin(F.col(k), grid[k]).alias("b")) for k in names if grid[k]]))
    grow, hold = rows.where("fold <> 0"), rows.where("fold = 0")
    for _ in range(max_rules):
        rule: list[Condition] = []
        left = ~learned.bad(of)
        while len(rule) < max_conditions:
            found = (
                grow.where(left & _all(rule, of)).select(bins.alias("x"), "bad").groupBy("x.f", "x.b")
                .agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count(F.lit(1)).alias("m")).collect()
            )
            by: dict[str, dict[int, tuple[int, int]]] = {}
            for r in found:
                by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["m"] - r["p"])
            if not by:
                break
            p0, n0 = (sum(x[i] for x in next(iter(by.values())).values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for k in sorted(by):
                for i, t in enumerate(grid[k]):
                    # bin b: b thresholds lie below the value, so b > i means value > grid[i]
                    p, n = (sum(x[j] for b, x in by[k].items() if b > i) for j in (0, 1))
                    for above, a, b in ((True, p, n), (False, p0 - p, n0 - n)):
                        if a >= least and (g := _gain(a, b, p0, n0)) > best[0]:
                            best = (g, Condition(k, above, float(t)))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # prune: the shortest prefix that is best on the rows held back
        tests = [a for i in range(1, len(rule) + 1) for a in (F.sum((_all(rule[:i], of) & F.col("bad")).cast("long")).alias(f"p{i}"), F.sum(_all(rule[:i], of).cast("long")).alias(f"m{i}"))]
        got = hold.where(left).agg(*tests).first()
        score = [((got[f"p{i}"] or 0) + 1) / ((got[f"m{i}"] or 0) + 2) for i in range(1, len(rule) + 1)]
        keep = score.index(max(score)) + 1
        if (got[f"p{keep}"] or 0) < precision * max(1, got[f"m{keep}"] or 0):
            break
        learned.rules.append(rule[:keep])
    return learned


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20000, **options) -> DecisionList:
    """Learn from the documents of at most about ``max_labelled`` labels.

    That sample has a bounded size, so it is broadcast; a label of quality 0
    marks the bad class."""
    sample = labelled_sample(labels, max_labelled).select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("bad"))
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    of = features()
    rows = Stored(
        with_statistics(joined).select("bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("fold"), *[c.alias(k) for k, c in of.items()]),
        "quality-labelled",
    )
    try:
        return learn(rows.df, list(of), **options)
    finally:
        rows.drop()


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """One row for each document: its statistics and the verdict."""
    out = with_statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    return out.select(
        "doc_id", "_s.n_words", "_s.word_chars", "_s.n_symbols", "_s.n_dup_lines", "_s.n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rules.bad(features())).alias("kept"),
    )


def filter_documents(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that pass, with all their columns."""
    out = with_statistics(docs.select(whole_row(docs).alias("row"), "text"))
    return out.where(~base_failed() & ~rules.bad(features())).select("row.*")
