"""Personal data by weak supervision, with DataFrame functions only.

Base patterns find emails, IPv4 addresses, payment cards and phone numbers; their spans always stay.
Loose patterns (written-out emails, IPv6, dotted cards, national phone numbers) give further
candidates that no base span overlaps.  Labelers vote on all of them: a format labeler, a
gazetteer (top-level domains, card issuers, area codes, address prefixes), a context labeler (words before
the span that announce its kind) and a counter-context labeler (words that announce something else).
Expectation-maximisation estimates how reliable each labeler is, and a logistic span classifier is
trained on its posteriors; it sees features of the span too (its length, the character before it, how many kinds of separators it
has).  Both see only the counts of patterns of votes and features, a table of fixed size
(four kinds, 3^4 votes, three lengths, four neighbours, four counts, base or not), which is all that reaches the driver.

One scan of the texts; its spans are written, counted, and read again.  The patterns are possessive, so
that neither long runs nor many repeats make them slow or deep.

Defined results: null text counts as empty and has no spans; repeated rows get the same spans; an empty table
gives an empty result; very long texts are searched whole; columns besides doc_id and text play no part.  Positions are
code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
#: A match can only start where its first run starts or the match before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\bat\b)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\bdot\b)\x20?[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][0-9]{8,13}(?![0-9])",
}
#: Cheap signs without which no pattern of the kind can match.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}
LOOSE_SIGNS = {"email": r"[\[(]at[\])]|\bat\b", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}[./_][0-9]{4}", "phone": r"[0-9]{3}[)\x20.-]|00[1-9][0-9]{8}"}
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|de|fr|es|uk|io)$",
    "ip": r"^(?:[1-9][0-9]{0,2}\.|[23fF][0-9A-Fa-f]{3}:)",
    "card": r"^(?:3[47]|4|5[1-5]|6011|65)",
    "phone": r"^(?:\+|00|\(?[2-9])",
}
FORMAT = {"email": r"@|[\[(]at[\])].*[\[(]dot[\])]", "ip": r".", "phone": r"^\+|^\([0-9]{3}\)|^([0-9]{3})([.-])[0-9]{3}\2[0-9]{4}$"}
CONTEXT = {
    "email": r"(?i)mail|contact|write|reach|address", "ip": r"(?i)\bip\b|host|server|address|login|from",
    "card": r"(?i)card|visa|master|amex|credit|pay", "phone": r"(?i)phone|call|tel|mobile|cell|fax|whatsapp|contact",
}
COUNTER = r"(?i)(?:version|isbn|issn|token|order|serial|part|section|build|release|doi|key|id)\W*$|[=#/_]$"
BEFORE, LABELERS, STEPS = 40, 4, 60
SPAN = "array<struct<kind:string,side:string,start:int,end:int,value:string,before:string>>"


def located(kind: str, side: str) -> str:
    """SQL for the matches of one pattern in column t: kind, side, start, end, value, before.  The pieces
    between matches give their places."""
    pattern = f"r'{(BASE if side == 'b' else LOOSE)[kind]}'"
    none, low = f"cast(array() as {SPAN})", f"greatest(s.at + x.gap - {BEFORE}, 0)"
    return f"""
    if(t rlike r'{(SIGNS if side == 'b' else LOOSE_SIGNS)[kind]}',
      transform(array(regexp_extract_all(t, {pattern}, 0)), m -> if(size(m) = 0, {none}, aggregate(
        zip_with(slice(split(t, {pattern}, -1), 1, size(m)), m,
                 (a, b) -> named_struct('gap', length(a), 'long', length(b), 'value', b)),
        named_struct('at', 0, 'out', {none}),
        (s, x) -> named_struct('at', s.at + x.gap + x.long, 'out', array_append(s.out, named_struct(
          'kind', '{kind}', 'side', '{side}', 'start', s.at + x.gap, 'end', s.at + x.gap + x.long, 'value', x.value,
          'before', substring(t, {low} + 1, s.at + x.gap - {low})))),
        s -> s.out)))[0],
      {none})"""


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """From the right, every second digit doubled; the digits of all add up to a multiple of 10."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a base match holds."""
    bare = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255)
    n = F.length(digits(value))
    card = F.when((n >= 13) & (n <= 19), luhn(digits(value))).otherwise(False)
    fits = F.when(kind == "ip", F.forall(F.split(value, r"\."), small)).when(kind == "phone", (n >= 9) & (n <= 15))
    return fits.when(kind == "card", card).otherwise(True)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def votes(kind: str, value: Column, before: Column) -> Column:
    """Pattern of one candidate: kind, votes (+, 0, -), and features: length class, the character before the span (none, white space,
    word, other), and kinds of separators within it (3 for more)."""
    yes, none, no = F.lit("+"), F.lit("0"), F.lit("-")
    form = luhn(digits(value)) if kind == "card" else value.rlike(FORMAT[kind])
    size = F.length(value)
    last = F.substring(before, -1, 1)
    inside = F.size(F.array_distinct(F.split(F.regexp_replace(value, "[A-Za-z0-9]", ""), "")))
    inside = F.when(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")) == 0, F.lit(0)).otherwise(F.least(inside, F.lit(3)))
    return F.concat(
        F.lit(KINDS.index(kind)),
        F.when(form, yes).otherwise(no if kind == "card" else none),
        F.when(value.rlike(GAZETTEER[kind]), yes).otherwise(no),
        F.when(before.rlike(CONTEXT[kind]), yes).otherwise(none),
        F.when(before.rlike(COUNTER), no).otherwise(none),
        F.when(size < 12, "s").when(size < 20, "m").otherwise("l"),
        F.when(last == "", "n").when(last.rlike(r"\s"), "s").when(last.rlike(r"\w"), "w").otherwise("p"),
        inside,
    )


def candidates(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id) and their candidates (row, kind, side, start, end, pattern), base matches
    that hold and all loose ones.  Both are read from one written scan."""
    every = ", ".join(located(k, side) for side in "bl" for k in KINDS)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.expr(f"concat({every})").alias("found"))
    found = scratch.write(found, "found")
    each = found.select("row", F.inline("found"))
    each = each.where((F.col("side") == "l") | valid(F.col("kind"), F.col("value")))
    pattern = F.lit(None).cast("string")
    for kind in KINDS:
        pattern = F.when(F.col("kind") == kind, votes(kind, F.col("value"), F.col("before"))).otherwise(pattern)
    return found.select("row", "doc_id"), scratch.write(each.select("row", "kind", "side", "start", "end", pattern.alias("pattern")), "candidates")


def reliabilities(counts: dict[tuple[str, bool], int]) -> tuple[float, list[dict[str, tuple[float, float]]], dict[tuple[str, bool], float]]:
    """Expectation-maximisation over (pattern, is base) counts: the prior, each labeler's chance of
    each vote given (not personal, personal), and the posterior of each pattern.  Being a base
    match is one more labeler."""
    cast = lambda key: [*key[0][1 : 1 + LABELERS], "+" if key[1] else "0"]
    post = {k: 0.95 if k[1] else 1 / (1 + math.exp(-sum({"+": 1, "0": 0, "-": -1.5}[v] for v in cast(k)) + 0.5)) for k in counts}
    prior, tables = 0.5, []
    for _ in range(STEPS):
        total = sum(counts.values()) + 2
        prior = (sum(n * post[k] for k, n in counts.items()) + 1) / total
        tables = []
        for j in range(LABELERS + 1):
            sums = {v: [0.5, 0.5] for v in "+0-"}
            for k, n in counts.items():
                sums[cast(k)[j]][0] += n * (1 - post[k])
                sums[cast(k)[j]][1] += n * post[k]
            whole = [sum(s[y] for s in sums.values()) for y in (0, 1)]
            tables.append({v: (s[0] / whole[0], s[1] / whole[1]) for v, s in sums.items()})
        for k in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][1] / t[v][0]) for t, v in zip(tables, cast(k), strict=True))
            post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, tables, post


def classifier(counts: dict[tuple[str, bool], int], post: dict[tuple[str, bool], float]) -> dict[str, float]:
    """A logistic of kind, votes and length, trained on the posteriors; its value for each pattern."""
    names = sorted({f"{j}{c}" for p, _ in counts for j, c in enumerate(p)})
    x = {k: [names.index(f"{j}{c}") for j, c in enumerate(k[0])] for k in counts}
    w, sums = [0.0] * len(names), [1e-6] * len(names)
    weight = {k: math.log1p(n) for k, n in counts.items()}
    for _ in range(300):
        g = [-0.01 * v for v in w]
        for k, at in x.items():
            gap = weight[k] * (post[k] - 1 / (1 + math.exp(-sum(w[i] for i in at))))
            for i in at:
                g[i] += gap
        for i, v in enumerate(g):
            sums[i] += v * v
            w[i] += 0.3 * v / math.sqrt(sums[i])
    return {p: 1 / (1 + math.exp(-sum(w[names.index(f"{j}{c}")] for j, c in enumerate(p)))) for p, _ in counts}


def supervised(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, base, added: spans (k: place of the kind, start, end, kind), sorted, of the base
    patterns, and those that the classifier adds.  A document's spans meet by its row, so
    that no group is larger than one text's."""
    rows, found = candidates(docs, scratch)
    counts = {(r.pattern, r.side == "b"): r.n for r in found.groupBy("pattern", "side").agg(F.count("*").alias("n")).collect()}
    scores = classifier(counts, reliabilities(counts)[2]) if counts else {}
    good = [p for p, s in sorted(scores.items()) if s >= 0.5]
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span, base = F.struct(place.alias("k"), "start", "end", "kind"), F.col("side") == "b"
    spans = found.where(base | F.col("pattern").isin(good)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"), F.array_sort(F.collect_list(F.when(~base, span))).alias("loose")
    )
    free = "filter(loose, s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end))"
    spans = spans.select("row", "base", F.when(F.size("loose") > 0, F.expr(free)).otherwise(F.col("loose")).alias("added"))
    return rows.join(spans, "row", "left").select("doc_id", *[F.coalesce(c, F.array()).alias(c) for c in ("base", "added")])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supervised(table(spark, sf_dir, "documents"), Scratch(spark, "pii"))
    return rows.select(
        "doc_id",
        *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
