"""Secret scans: pattern spans, and weak parts linked by an interval join.

Strong spans (an assignment, an access id, a long hex run) are reported as
they are. Weak candidates (a session id, a bare 40-character secret, an
endpoint) are reported only when complementary parts stand in the same scope,
the same document within ``scope`` code points:

* ``wid``       with any secret (assign, hex, wsecret),
* ``wsecret``   with any id (access, wid),
* ``endpoint``  with an id and a secret.

Only DataFrame operations are used. Matches leave the map stage as lengths of
matches and of the gaps between them; a running sum over a document's matches
gives the places. The interval join is an equi-join on document and scope bin,
each weak span standing in all bins from its start to its end and each part
also in the bins beside its own, followed by the exact distance, so its work is linear in the spans. The text itself is never
shuffled.

Defined results: a null text counts as empty; a document without spans has
zero counts, the digest of the empty string and empty ``spans``; repeated
rows and repeated or null ids each keep their own row; extra columns are
ignored; an empty table gives an empty result. Places are counted in code
points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, once

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
WEAK_IDS = ("ASIA", "AROA", "AIDA", "AGPA", "ANPA", "ANVA", "AIPA")
KINDS = [
    ("assign", ASSIGN),
    ("access", "AKIA[A-Z0-9]{16,}"),
    ("hex", "[0-9a-f]{24,}"),
    ("wid", rf"\b(?:{'|'.join(WEAK_IDS)})[A-Z0-9]{{16}}\b"),
    ("wsecret", "(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    ("endpoint", r"https?://[^\x20\x09-\x0D\"'<>|]+"),
]
ORDER = {k: i for i, (k, _) in enumerate(KINDS)}
STRONG = ("assign", "access", "hex")
IDS, SECRETS = ("access", "wid"), ("assign", "hex", "wsecret")


def _sound(kind: str, found: Column, value: Column) -> Column:
    """Whether a match counts. Greedy runs of too few characters don't; they
    were matched all the same, so that they hide what they overlap."""
    if kind == "assign":
        return F.char_length(value) >= 6
    if kind == "wsecret":
        return found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9]")
    return F.lit(True)


def _possible(kind: str) -> Column:
    """What a text must have for a span of the kind to be reported: cheap to
    tell, and a reason to leave the patterns for few texts. A weak secret or
    endpoint needs an id in its text."""
    t = F.col("_t")
    weak_id = t.contains(WEAK_IDS[0])
    for x in WEAK_IDS[1:]:
        weak_id = weak_id | t.contains(x)
    return {
        "assign": t.contains("=") | t.contains(":"),
        "access": t.contains("AKIA"),
        "hex": t.rlike("(?<![0-9a-f])[0-9a-f]{24}"),
        "wid": weak_id,
        "wsecret": t.contains("AKIA") | weak_id,
        "endpoint": t.contains("://") & (t.contains("AKIA") | weak_id),
    }[kind]


def _found(kind: str, pattern: str) -> Column:
    """The matches in ``_t`` with the lengths of the gaps before them."""
    t, all_of = F.col("_t"), lambda group: F.regexp_extract_all(F.col("_t"), F.lit(pattern), F.lit(group))
    value = all_of(1).alias("v") if kind == "assign" else F.array().cast("array<string>").alias("v")
    full = F.arrays_zip(all_of(0).alias("m"), value, F.split(t, pattern, -1).alias("g"))
    return F.transform(
        F.filter(full, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(ORDER[kind]).alias("kind"), i.alias("rank"), F.char_length(x["g"]).alias("gap"),
            F.char_length(x["m"]).alias("len"), _sound(kind, x["m"], x["v"]).alias("sound"),
        ),
    )


def _hits(docs: DataFrame, text: str) -> DataFrame:
    """rid, doc_id and ``_hits``: kind, rank, gap before, length, sound."""
    out = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    names = []
    none = F.array().cast("array<struct<kind:int,rank:int,gap:int,len:int,sound:boolean>>")
    for kind, pattern in KINDS:
        out = once(out, f"_{kind}", F.when(_possible(kind), _found(kind, pattern)).otherwise(none))
        names.append(f"_{kind}")
    return out.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat(*names).alias("_hits"))


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """Weak spans with complementary parts in their scope."""
    weak = spans.where(F.col("kind") >= ORDER["wid"])
    role = F.when(F.col("kind").isin([ORDER[k] for k in IDS]), "id").when(F.col("kind").isin([ORDER[k] for k in SECRETS]), "secret")
    parts = spans.withColumn("role", role).where("role is not null").select(
        "rid", F.col("start").alias("s2"), F.col("end").alias("e2"), "role",
        F.explode(F.sequence(F.expr(f"start div {scope} - 1"), F.expr(f"end div {scope} + 1"))).alias("bin"),
    )
    near = (F.col("s2") - F.col("end") <= scope) & (F.col("start") - F.col("e2") <= scope)
    has = lambda r: F.max((F.col("role") == r).cast("int"))
    met = (
        weak.withColumn("bin", F.explode(F.expr(f"sequence(start div {scope}, end div {scope})"))).join(parts, ["rid", "bin"]).where(near)
        .groupBy("rid", "kind", "start", "end").agg(has("id").alias("ids"), has("secret").alias("secrets"))
    )
    need = (
        F.when(F.col("kind") == ORDER["wid"], F.col("secrets") == 1)
        .when(F.col("kind") == ORDER["wsecret"], F.col("ids") == 1)
        .otherwise((F.col("ids") == 1) & (F.col("secrets") == 1))
    )
    return met.where(need).select("rid", "kind", "start", "end")


def scan(docs: DataFrame, scope: int = 300, text: str = "text") -> DataFrame:
    """One row for each document: rid, doc_id and ``found``, its spans in
    order of start and kind as structs (start, kind, end)."""
    rows = Stored(_hits(docs, text), "secret-hits").df
    order = Window.partitionBy("rid", "kind").orderBy("rank")
    end = F.sum((F.col("gap") + F.col("len")).cast("long")).over(order)
    spans = (
        rows.where(F.size("_hits") > 0).select("rid", F.inline("_hits"))
        .withColumn("end", end).where("sound")
        .select("rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    )
    kept = spans.where(F.col("kind") < ORDER["wid"]).unionByName(_linked(spans, scope))
    lists = kept.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select("rid", "doc_id").join(lists, "rid", "left").withColumn("found", F.coalesce("found", none))


def spelled(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k, _ in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def report(docs: DataFrame, scope: int = 300, text: str = "text") -> DataFrame:
    """Counts and digest of the strong spans, and all spans in writing."""
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == ORDER[k])).cast("long").alias(f"n_{k}")
    base = F.filter(found, lambda x: x["kind"] < ORDER["wid"])
    return scan(docs, scope, text).select(
        "doc_id", *[count(k) for k in STRONG], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(found).alias("spans")
    )
