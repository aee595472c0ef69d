"""Mixing to target weights when domains are only softly known.

A labelled table names the domain of some documents. A naive Bayes classifier
over the presence and absence of the words that tell domains apart gives every document its posterior over
domains. Document rates w are then fitted, by projected gradients, to the least of

    1/2 sum_k ((sum_d w_d n_d p_dk - T_k) / S)^2
        + ridge/2 sum_d (n_d / S) (w_d - 1)^2,    0 <= w <= max_rate

with n_d tokens, posteriors p_dk, target totals T_k and S tokens in all. In the
metric that weighs a document by its tokens the gradient of w_d is
sum_k p_dk r_k + ridge (w_d - 1), r the residuals: one number a domain. Where
the projected gradient is zero, w_d = clip(1 - sum_k p_dk r_k / ridge), so that
the fit is that of a force r_k / ridge for each domain. Plain gradient steps
close a rare domain's gap by its share a round, hundreds of rounds for a share
of 0.01; the forces are therefore found by Newton steps on the dual problem,
concave in one number a domain, until what is left of every domain is small
against its target. Each round is one aggregate of one row, and a document's
rate is a plain expression in its posteriors. No rates are stored, no lineage
grows, and all work is linear in the documents. The ridge is small against the
rarest target, so that it doesn't hold totals off. ``Rates.totals`` has totals
beside their targets; targets out of reach (``max_rate``) stay apart there.

Only DataFrame operations are used. The classifier counts a bounded sample of
labelled rows (``max_labelled``) and keeps the ``max_words`` most telling of
the words in at least ``least_docs`` documents whose chi-squared against the
domains is more than ``telling``; posteriors, totals and rates cover all documents and whole texts.

Defined results: a null or empty text has no tokens and the posterior of a
text with none of the words; ids labelled more than once count once for each domain named;
repeated rows keep a row each, and rows of one id are rounded alike; without labelled documents every rate is 1;
an empty table gives an empty result; extra columns are carried by ``apply``.
"""

from __future__ import annotations

import logging
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, labelled_sample, once, whole_row

log = logging.getLogger(__name__)

#: Parts of the table of words, by hash.
PARTS = 64

#: Newton steps at the most; a fit takes a few.
MOST_ROUNDS = 60

#: Splits words, and words from the marks behind them.
PIECES = r"[\x20\x09-\x0D]+|(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}\x20\x09-\x0D])"


def pieces(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), PIECES), "")


@dataclass
class DomainModel:
    domains: list[str] = field(default_factory=list)
    priors: list[float] = field(default_factory=list)
    weights: dict[str, list[float]] = field(default_factory=dict)  # word: P(word in a document | domain)

    def posterior(self, words: Column) -> Column:
        """An array of probabilities in the order of ``domains``."""
        k = len(self.domains)
        if k < 2:
            return F.array(*[F.lit(1.0)] * k).cast("array<double>")
        absent = [sum(math.log(1 - p[i]) for p in self.weights.values()) for i in range(k)]
        logits = F.array(*[F.lit(math.log(p) + a) for p, a in zip(self.priors, absent, strict=True)])
        if self.weights:
            told = sorted(self.weights)
            # a literal map is searched from its start: many short ones, by CRC-32, are not
            parts: list[list[str]] = [[] for _ in range(PARTS)]
            for w in told:
                parts[zlib.crc32(w.encode("utf-8", "surrogatepass")) % PARTS].append(w)
            entry = lambda w: (F.lit(w), F.array(*[F.lit(math.log(p / (1 - p))) for p in self.weights[w]]))
            none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<double>>"))
            table = F.array(*[F.create_map(*[x for w in p for x in entry(w)]) if p else none for p in parts])
            hits = F.array_distinct(F.filter(words, lambda w: w.isin(told)))
            of = lambda w: F.element_at(F.get(table, (F.crc32(w.cast("binary")) % PARTS).cast("int")), w)
            logits = F.aggregate(hits, logits, lambda acc, w: F.zip_with(acc, of(w), lambda a, b: a + b))
        top = lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))
        part = F.transform(F.array(logits), lambda a: F.transform(F.array(top(a)), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))))
        return F.flatten(F.flatten(part))


def domain_labels(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, domain) from graded labels: low, toxic or good."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") > 0, "toxic").otherwise("good")
    return labelled_sample(labels, max_labelled).select("doc_id", domain.alias("domain"))


def fit_domains(docs: DataFrame, labelled: DataFrame, max_words: int = 400, least_docs: int = 5, telling: float = 30.0) -> DomainModel:
    """Fit on the documents of ``labelled`` (doc_id, domain), a table of
    bounded size, which is broadcast."""
    named = labelled.where("doc_id is not null and domain is not null").distinct().withColumnRenamed("doc_id", "_id")
    joined = docs.select("doc_id", "text").join(F.broadcast(named), F.col("doc_id") == F.col("_id"))
    words = Stored(joined.select("domain", F.array_distinct(pieces(F.col("text"))).alias("words")), "domain-words")
    counts = {r["domain"]: r["count"] for r in words.df.groupBy("domain").count().collect()}
    domains = sorted(counts)
    total = sum(counts.values())
    model = DomainModel(domains, [(counts[d] + 0.5) / (total + 0.5 * len(domains)) for d in domains])
    if len(domains) < 2:
        return model
    has = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)]
    by_word = words.df.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *has)
    # chi-squared of presence against domain, summed over domains
    chi = F.lit(0.0)
    for k, d in enumerate(domains):
        expected = F.col("n") * (counts[d] / total)
        chi = chi + F.pow(F.col(f"n{k}") - expected, 2) / expected
    told = by_word.where(F.col("n") >= least_docs).withColumn("chi", chi).where(F.col("chi") > telling).orderBy(F.desc("chi"), "word").limit(max_words).collect()
    words.drop()
    for r in told:
        model.weights[r["word"]] = [(r[f"n{k}"] + 0.5) / (counts[d] + 1.0) for k, d in enumerate(domains)]
    return model


@dataclass
class Rates:
    """The rate of a document as an expression in its posterior."""

    step: float
    ridge: float
    max_rate: float
    residuals: list[list[float]] = field(default_factory=list)
    forces: list[float] = field(default_factory=list)
    totals: dict[str, tuple[float, float]] = field(default_factory=dict)  # domain: tokens, target

    def column(self, posterior: Column) -> Column:
        if self.forces:
            w = F.lit(1.0)
            for k, x in enumerate(self.forces):
                w = w - F.get(posterior, k) * x
            return F.greatest(F.lit(0.0), F.least(F.lit(self.max_rate), w))
        w = F.lit(1.0)
        for r in self.residuals:
            pull = F.lit(0.0)
            for k, x in enumerate(r):
                pull = pull + F.get(posterior, k) * x
            w = F.greatest(F.lit(0.0), F.least(F.lit(self.max_rate), w * (1 - self.step * self.ridge) + self.step * self.ridge - pull * self.step))
        return w


def with_posterior(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """Add ``_n`` (tokens) and ``_p`` (posterior)."""
    out = once(docs, "_w", pieces(F.col(text)))
    return once(out.withColumn("_n", F.size("_w").cast("long")), "_p", model.posterior(F.col("_w"))).drop("_w")


def fit_rates(soft: DataFrame, model: DomainModel, targets: dict[str, float], anchor: str | None = None, max_rate: float = 4.0, ridge: float | None = None, rounds: int | None = None, tolerance: float = 1e-3) -> Rates:
    """Fit on ``soft``: ``_n`` and ``_p`` of all documents.

    Targets are shares; a domain without one gets 0. The total is that of the
    documents, or, with an ``anchor``, such that this domain keeps its own. The
    fit ends when no domain's gradient is more than ``tolerance`` of its target.
    With ``rounds``, so many plain gradient steps are made instead."""
    k, share = len(model.domains), [targets.get(d, 0.0) for d in model.domains]
    rarest = min((x / sum(share) for x in share if x), default=1.0)
    if ridge is None:
        ridge = 0.01 if rounds else 1e-3 * rarest
    rates = Rates(1 / (1 + ridge), ridge, max_rate)
    if not k or not sum(share):
        return rates
    share = [s / sum(share) for s in share]
    n = F.col("_n")
    tokens = lambda w: [F.sum(w * n * F.get("_p", i)).alias(f"t{i}") for i in range(k)]
    first = soft.agg(F.sum("_n").alias("s"), *tokens(F.lit(1.0))).first()
    s = first["s"] or 0
    if not s:
        return rates
    at = model.domains.index(anchor) if anchor in model.domains else None
    total = s if at is None or not share[at] else first[f"t{at}"] / share[at]
    goal = np.array(share) * total
    if rounds:
        for _ in range(rounds):
            got = soft.agg(*tokens(rates.column(F.col("_p")))).first()
            now = [(got[f"t{i}"] - goal[i]) / s for i in range(k)]
            if rates.residuals and max(abs(a - b) for a, b in zip(now, rates.residuals[-1], strict=True)) < tolerance:
                break
            rates.residuals.append(now)
        return rates

    def dual(force: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Value, gradient and curvature of the dual problem, and totals."""
        w = Rates(1.0, ridge, max_rate, forces=force.tolist()).column(F.col("_p"))
        pull = sum((F.get("_p", i) * float(x) for i, x in enumerate(force)), F.lit(0.0))
        free = ((w > 0) & (w < max_rate)).cast("double")
        bent = [F.sum(free * n * F.get("_p", i) * F.get("_p", j)).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1)]
        got = soft.agg(F.sum(n * ((w - 1) * (w - 1) / 2 + pull * w)).alias("v"), *tokens(w), *bent).first()
        t = np.array([got[f"t{i}"] for i in range(k)])
        h = np.array([[got[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) / s
        return got["v"] / s - force @ goal / s - ridge / 2 * force @ force, (t - goal) / s - ridge * force, h + ridge * np.eye(k), t

    aim = np.maximum(goal, rarest * total) / s
    force = np.zeros(k)
    value, gradient, curve, t = dual(force)
    for _ in range(MOST_ROUNDS):
        if (np.abs(gradient) <= tolerance * aim).all():
            break
        way, step = np.linalg.solve(curve, gradient), 1.0
        while step > 1e-9:
            new = dual(force + step * way)
            if new[0] >= value + 1e-4 * step * (gradient @ way):
                break
            step /= 4
        else:
            break
        force = force + step * way
        value, gradient, curve, t = new
    rates.forces = force.tolist()
    rates.totals = {d: (float(t[i]), float(goal[i])) for i, d in enumerate(model.domains)}
    left = np.abs(gradient) / aim
    log.log(logging.WARNING if left.max() > tolerance else logging.INFO, "tokens and targets by domain: %s; gradient left, as a share of targets: %s", rates.totals, left.tolist())
    return rates


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> tuple[DomainModel, Rates, DataFrame]:
    """The classifier, the rates, and ``row``, _n and _p of each document; the
    fit reads the last two columns alone."""
    model = fit_domains(docs, labelled)
    rows = docs.select(whole_row(docs).alias("row"), "text")
    soft = Stored(with_posterior(rows, model).select("row", "_n", "_p"), "soft-domains").df
    return model, fit_rates(soft.select("_n", "_p"), model, targets, **options), soft


def report(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """Tokens, posterior by domain, rate and whole copies of each document."""
    model = fit_domains(docs, labelled)
    soft = Stored(with_posterior(docs.select("doc_id", "text"), model).drop("text"), "soft-domains").df
    rates = fit_rates(soft.select("_n", "_p"), model, targets, **options)
    soft = soft.withColumn("rate", rates.column(F.col("_p")))
    named = [F.get("_p", model.domains.index(d)).alias(f"p_{d}") if d in model.domains else F.lit(None).cast("double").alias(f"p_{d}") for d in sorted(targets)]
    return soft.select("doc_id", F.col("_n").alias("n_tokens"), *named, "rate", copies(F.col("rate")).alias("copies"))


def copies(rate: Column, key: str = "doc_id") -> Column:
    """The rate rounded up or down by the hash of the id, right on average."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit("copies")), F.lit(1 << 24)) / float(1 << 24)
    return F.floor(rate + place).cast("int")


def apply(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The documents, each as often as its copies say, with their columns."""
    _, rates, soft = mix(docs, labelled, targets, **options)
    out = once(soft, "_c", copies(rates.column(F.col("_p")), "row.doc_id"))
    return out.where("_c > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_k")).select("row.*")
