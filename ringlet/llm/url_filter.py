"""URL filter: host and path rules, then a logistic regression on hashed character n-grams.

The regression is trained on the driver from a small labelled URL table; scoring needs no shuffle.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and the
verdict of the regression on nothing; repeated rows are judged alike; urls of any length are read whole; columns besides
page_id and url play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.llm.common import ascii_lower, table, tidy

#: (rule, verdict): host, then path from its first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BITS, SHORTEST, LONGEST, STEPS, RATE, L2 = 16, 2, 5, 300, 0.5, 2e-3

#: The labelled table: names that hosts of either kind bear.  1: block.
BAD_NAMES = (
    "cheap-pills", "free-bets", "spam-farm", "adult-x", "casino-win", "xxx-videos", "best-viagra", "payday-loans",
    "ads-server", "track-ads", "ads-banner", "click-track", "hot-singles", "win-prizes", "replica-watches", "click-here-now", "sex-chat", "poker-bonus", "crypto-doubler",
    "cheap-meds", "free-coins", "spam-links", "adult-cams", "pills-online", "bets-online", "link-farm", "porn-tube",
)
GOOD_NAMES = (
    "library", "university", "weather", "gardening", "history-notes", "museum", "cooking", "mathematics", "rivertown",
    "herald", "science-daily", "openmaps", "recipes", "languages", "theatre", "interior", "astronomy", "forest",
    "thinker", "another", "mother-earth", "northern", "station", "reading-room", "harbour", "worthington", "children",
)


def labelled_urls() -> list[tuple[str, int]]:
    """The small table: names of either kind in hosts with plain paths, and in paths on plain hosts and on hosts of good names, so
    that hosts and paths are learnt apart.  A url with a bad name anywhere is to be blocked."""
    hosts = ("http://www.{}.example.com/en/12", "https://blog.{}.example.org/fr/7.html", "https://{}.example.net/de/345/", "http://m.{}.example.com/es/99?page=2", "https://{}.example.org/")
    paths = ("http://www.example.com/{}", "https://example.org/en/{}/7.html", "https://m.example.net/{}-12/", "http://example.com/de/345/{}?x=1")
    rows = [(f.format(n), y) for y, names in ((1, BAD_NAMES), (0, GOOD_NAMES)) for n in names for f in (*hosts, *paths)]
    for k, (bad, good) in enumerate(zip(BAD_NAMES, GOOD_NAMES, strict=True)):
        other = GOOD_NAMES[(k + 5) % len(GOOD_NAMES)]
        rows += [(f"https://{good}.example.org/{bad}/", 1), (f"https://{bad}.example.org/{good}/", 1), (f"https://{good}.example.org/{other}/", 0)]
    return rows


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ngrams(host: str, path: str) -> list[int]:
    """Hashed character n-grams of ^host$ and ^path$, kept apart."""
    out = []
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in range(SHORTEST, LONGEST + 1):
            out += {xxhash.xxh3_64_intdigest(f"{kind}{text[i : i + n]}") & ((1 << BITS) - 1) for i in range(len(text) - n + 1)}
    return out


def train(rows: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and constant from (host, path, label); features weigh 1 over the root of their number."""
    lists, y = [ngrams(h, p) for h, p, _ in rows], np.array([y for *_, y in rows], float)
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), list(map(len, lists)))
    value = 1 / np.sqrt(np.array(list(map(len, lists)), float))[owner]
    w, b, h, hb = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-6), 1e-6
    for _ in range(STEPS):
        score = np.bincount(owner, weights=w[flat] * value, minlength=len(y)) + b
        gap = (y - 1 / (1 + np.exp(-score))) / len(y)
        g, gb = np.bincount(flat, weights=gap[owner] * value, minlength=len(w)) - L2 / len(y) * w, gap.sum()
        h += g * g
        hb += gb * gb
        w += RATE * g / np.sqrt(h)
        b += RATE * gb / np.sqrt(hb)
    return w, float(b)


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min((rest + "/?#").find(c) for c in "/?#")
    return rest[:end].lower(), rest[end:].partition("?")[0].partition("#")[0]


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, urls: list[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's block_score of every url."""
    weights, constant = train([(*_split(u), y) for u, y in urls or labelled_urls()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = ngrams(h, p)
                scores.append(1 / (1 + np.exp(-(weights[found].sum() / np.sqrt(max(len(found), 1)) + constant))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["page_id", "host", "path", "block_score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    url = F.col("url")
    parts = pages.select("page_id", F.coalesce(host(url), F.lit("")).alias("host"), F.coalesce(path(url), F.lit("")).alias("path"))
    out = parts.mapInArrow(tidy(run), f"page_id {kind}, host string, path string, block_score double").withColumn("_rule", ruled(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "_rule.rule", F.coalesce("_rule.verdict", method).alias("verdict"), "block_score")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
