"""Quality by regularised quadratic discriminant analysis.

Each whole text gives transformed statistics (lengths, shares of kinds of characters, repeats of words and
lines, compressibility).  Each class has its mean and a covariance shrunk towards the pooled one and its
diagonal.  The score is a logistic of the difference of the classes' Mahalanobis
log-densities, which come from Cholesky factors computed once at fitting.

Fitting uses at most ``MOST`` labelled documents of each class, chosen by hash; scoring covers every row.

Defined results: null and blank texts have the statistics of the empty text and are scored by
them; null labels count as none; of several labels of a document the highest holds; with fewer than two
rows of a class, every score is the share of good rows (0.5 without any); very long texts are read whole; columns besides
doc_id and text play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.llm.common import Scratch, table, tidy
from ringlet.llm.toxicity import held_out, labelled_sample, logistic

MOST, THRESHOLD, SHRINK_POOLED, SHRINK_DIAGONAL = 20_000, 0.7, 0.1, 0.05
NAMES = (
    "length", "word_length", "symbols", "pipes", "bangs", "upper", "digits", "distinct", "top_word",
    "same_next", "line_repeats", "lines", "compression", "trigram_repeats", "odd_tokens", "spread",
)
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_PLAIN = _UPPER | _DIGIT
_PLAIN[97:123] = _PLAIN[128:] = True
_PLAIN[[9, 10, 11, 12, 13, 32, 44, 46]] = True


def statistics(text: bytes | None) -> np.ndarray:
    """The transformed statistics ``NAMES`` of one text."""
    text = text or b""
    words = text.lower().split()
    n, m = len(words), max(len(text), 1)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    share = lambda k: np.log(k / m + 1e-3)
    lengths = np.fromiter(map(len, words), np.int64, n)
    odd = sum(c for w, c in counts.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,"))
    return np.array([
        np.log1p(n),
        np.log1p(lengths.mean()) if n else 0.0,
        share(int(by_byte[~_PLAIN].sum())),
        share(int(by_byte[124])),
        share(int(by_byte[33])),
        share(int(by_byte[_UPPER].sum())),
        share(int(by_byte[_DIGIT].sum())),
        np.log((len(counts) + 1) / (n + 1)) / np.log(n + 3),
        np.log((max(counts.values(), default=0) + 1) / (n + 10)),
        np.log((sum(map(bytes.__eq__, words, words[1:])) + 0.3) / (n + 3)),
        np.log((len(lines) - len(set(lines)) + 0.3) / (len(lines) + 3)),
        np.log((len(lines) + 1) / (n + 1)),
        np.log((len(zlib.compress(text, 1)) + 1) / (len(text) + 12)),
        np.log((max(n - 2, 0) - len(set(zip(words, words[1:], words[2:], strict=False))) + 0.3) / (n + 3)),
        np.log((odd + 0.3) / (n + 3)),
        np.log1p(lengths.std()) if n else 0.0,
    ])


@dataclass
class Discriminant:
    """Standardising centre and scale; means, inverse Cholesky factors and log-determinants of the
    classes; slope and constant of the logistic; and the score where nothing could be fitted."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    link: np.ndarray
    flat: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        d = [-0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) - 0.5 * self.logdets[k] for k in (0, 1)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(_link(self.difference(x)) @ self.link, -30, 30)))


def _link(d: np.ndarray) -> np.ndarray:
    d = np.arcsinh(d)
    return np.stack([d, np.maximum(d, 0), np.ones_like(d)], axis=1)


def discriminant(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fit both classes' shrunk covariances and the logistic of the difference."""
    nothing = np.zeros(x.shape[1] if x.ndim == 2 else len(NAMES))
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        flat = float(y.mean()) if len(y) else 0.5
        return Discriminant(nothing, nothing + 1, np.zeros((2, 0)), np.zeros((2, 0, 0)), np.zeros(2), np.zeros(3), flat)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    means = np.stack([z[y == k].mean(axis=0) for k in (0, 1)])
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * covs[k] for k in (0, 1))
    factors, logdets = [], []
    for cov in covs:
        cov = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
        cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * np.log(np.diag(lower)).sum())
    model = Discriminant(centre, scale, means, np.stack(factors), np.array(logdets), np.zeros(3))
    model.link = logistic(_link(model.difference(x)), y)
    return model


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, parts: int = 4, which: int = 2) -> Discriminant:
    sample = labelled_sample(docs, labels, "quality", parts, which, {0: MOST, 1: MOST}, scratch)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.select("text", "y").mapInArrow(tidy(stats), "x array<double>, y int").collect()
    rows.sort()
    return discriminant(np.array([r.x for r in rows]), np.array([r.y for r in rows]))


def scored(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score, and the statistics behind it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([statistics(t.as_py()) for t in batch.column(1)])
            arrays = [batch.column(0), pa.array(model.score(x)), pa.array(x.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "statistics"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, score double, statistics array<double>")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "quality"))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
