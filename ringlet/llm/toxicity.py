"""Toxicity by a linear-chain conditional random field.

Tokens are runs between ASCII white space; each is clean or toxic.  Token labels come from the
document labels: features (a word, or its first 4, 5 or 6 letters) whose share of toxic documents is surely
above their share of clean ones (Wilson bounds, so the sample's class ratio plays no part) are candidates.  Words that are
candidates are toxic, and a greedy cover takes, one after another, the stem that explains most toxic documents left.  Near
copies in the sample are left out by a sketch first, so that copies of one document do not make its other words toxic.
Candidates may occur in clean documents: the field weighs them by both.  The field is trained on the whole texts of the sample, cut into windows of
tokens, by full-batch gradient steps on its log-likelihood.  Each document is then run through
forward-backward.  Its score is a logistic of what the marginals add up to (their noisy-or, the two
largest, how many are high), with coefficients from the same labelled documents; tokens over
one half give the offending offsets (code points).

Fitting uses at most ``MOST_TOXIC`` + ``MOST_CLEAN`` labelled documents, chosen by hash; scoring
covers every whole text.

Defined results: null and blank texts have no tokens and get the score of no suspicion; labels that are null count
as none; of several labels of a document the highest holds; very long texts are tagged whole; columns besides doc_id and text
play no part; with no toxic labels to learn from, every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.llm.common import Scratch, table, tidy
from ringlet.llm.shingles import forget, shingle_set

MOST_TOXIC, MOST_CLEAN = 2_000, 4_000
HASH_BITS, WINDOW, STEPS, RATE, L2 = 18, 24, 60, 0.3, 1e-4
THRESHOLD, SUSPICIOUS, UNLIKELY, SURE = 0.7, 0.05, 2, 2.5
_ORDERS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)))
_SUB = re.compile(r"[^\W_]+")
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
#: Tokens whose emissions are remembered (some 25 MB), tokens of a run of documents, windows of a training step.
_CACHE, _BATCH_TOKENS, _BATCH_WINDOWS = 200_000, 250_000, 4_096


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == which


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, which: int, most: dict[int, int], scratch: Scratch) -> DataFrame:
    """doc_id, text, label of at most ``most[label]`` (or few more) labelled documents that are not held
    out, chosen by hash; of several texts of a document the first in byte order.  The chosen ids are bounded, so they are broadcast."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = scratch.write(known.where(~held_out(F.col("doc_id"), parts, which)), "known")
    there = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    take = F.lit(False)
    for y, n in there.items():
        share = min(1.0, most[y] / n)
        take |= (F.col("y") == y) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 53)) < int(share * (1 << 53)))
    chosen = F.broadcast(known.where(take).select(F.col("doc_id").alias("_id"), "y"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").join(chosen, F.col("doc_id") == F.col("_id"))
    return scratch.write(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), "sample")


def features(word: str) -> list[str]:
    """The word, and its first 4, 5 and 6 letters where it is longer."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)]


def _words(text: bytes) -> list[str]:
    return _SUB.findall(text.decode("utf-8", "replace").lower())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by label, over the partition."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[y].update({f for w in set(_words(text)) for f in features(w)})
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        arrays = [pa.array(part), *(pa.array([c[f] for f in part], pa.int64()) for c in counts)]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "n0", "n1"])


def bound(k: Column, n: int, z: float) -> Column:
    """Wilson bound of a share of k in n, the upper one for z > 0, the lower one for z < 0."""
    n = max(n, 1)
    p = k / n
    return (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def candidates(counted: DataFrame, n_clean: int, n_toxic: int) -> DataFrame:
    """Rows (feature, n0, n1) surely commoner in toxic than in clean documents."""
    return counted.where(bound(F.col("n1"), n_toxic, -SURE) > bound(F.col("n0"), n_clean, SURE))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the least shingle under each of four orders."""
    for batch in batches:
        out = []
        for text in batch.column(1):
            h = shingle_set(text.as_py())
            out.append([int(((h ^ (h >> np.uint64(29))) * m).min() >> np.uint64(1)) for m in _ORDERS] if len(h) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "least"])


def without_copies(sample: DataFrame, scratch: Scratch) -> DataFrame:
    """The sample less the rows that share a least shingle with one of a smaller doc_id, as near copies do."""
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text").mapInArrow(tidy(_sketch, forget), f"doc_id {kind}, least array<long>").collect()
    seen: list[set[int]] = [set() for _ in _ORDERS]
    kept = []
    for r in sorted(rows):
        if not any(x in s for x, s in zip(r.least, seen, strict=False)):
            kept.append((r.doc_id,))
        for x, s in zip(r.least, seen, strict=False):
            s.add(x)
    if len(kept) == len(rows):
        return sample
    ids = sample.sparkSession.createDataFrame(kept, f"doc_id {kind}")
    return scratch.write(sample.join(F.broadcast(ids), "doc_id"), "fresh")


def cover(docs: list[list[str]], clean: dict[str, int], n_clean: int, least: int = 3) -> list[str]:
    """Features that explain the toxic documents, greedily; docs: the candidates in each.

    A feature is worth the documents not yet explained, less what clean ones make likely.  Worth
    only falls, so a heap with stale entries finds the best; shorter names win ties.
    """
    having: dict[str, list[int]] = {}
    for i, found in enumerate(docs):
        for f in found:
            having.setdefault(f, []).append(i)
    left = {f: len(s) for f, s in having.items()}
    worth = lambda f: left[f] - UNLIKELY * len(docs) * clean[f] / max(n_clean, 1)
    heap = [(-worth(f), len(f), f) for f in left]
    heapify(heap)
    explained, seeds = set(), []
    while heap:
        value, size, f = heappop(heap)
        now = worth(f)
        if now < least:
            continue
        if now < -value:
            heappush(heap, (-now, size, f))
            continue
        seeds.append(f)
        for i in having[f]:
            if i not in explained:
                explained.add(i)
                for g in docs[i]:
                    left[g] -= 1
    return seeds


@dataclass
class Crf:
    """weights: of hashed features, for toxic against clean; start, trans: log potentials;
    pool: coefficients of ``pooled``."""

    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    pool: np.ndarray | None = None

    def emission(self, word: str) -> float:
        return float(self.weights[hashed(word)].sum())


def hashed(word: str) -> list[int]:
    mask = (1 << HASH_BITS) - 1
    return [xxhash.xxh3_64_intdigest(f) & mask for f in ("bias", *features(word), f"{word[:3]}^", f"{word[-3:]}$")]


def _chains(e: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward (normalised) and marginals of equally long windows; e: (n, length)."""
    n, length = e.shape
    emit = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
    a, s = np.exp(trans), np.exp(start)
    fwd, bwd, scale = np.empty((n, length, 2)), np.empty((n, length, 2)), np.empty((n, length))
    for t in range(length):
        x = (s if t == 0 else fwd[:, t - 1] @ a) * emit[:, t]
        scale[:, t] = x.sum(axis=1)
        fwd[:, t] = x / scale[:, t, None]
    bwd[:, -1] = 1
    for t in range(length - 2, -1, -1):
        bwd[:, t] = ((emit[:, t + 1] * bwd[:, t + 1]) @ a.T) / scale[:, t + 1, None]
    return fwd, bwd, emit / scale[:, :, None], fwd * bwd


def train(words: list[str], ids: np.ndarray, y: np.ndarray) -> Crf:
    """Full-batch AdaGrad on the penalised log-likelihood of windows of ``WINDOW`` tokens.

    ids: places in ``words`` of the tokens of each window; y: their tags.  Gradients are summed over
    batches of windows, which bounds the memory and not what is read."""
    lists = [hashed(w) for w in words]
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), list(map(len, lists)))
    w, start, trans = np.zeros(1 << HASH_BITS), np.zeros(2), np.zeros((2, 2))
    sums = [np.full_like(x, 1e-8) for x in (w, start, trans)]
    pairs = np.stack([[((y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    first = np.array([(y[:, 0] == i).sum() for i in (0, 1)])
    for _ in range(STEPS):
        e = np.bincount(owner, weights=w[flat], minlength=len(lists))
        by_word, heads, expected = np.zeros(len(lists)), np.zeros(2), np.zeros((2, 2))
        for at in range(0, len(y), _BATCH_WINDOWS):
            part = slice(at, at + _BATCH_WINDOWS)
            fwd, bwd, emit, m = _chains(e[ids[part]], start, trans)
            by_word += np.bincount(ids[part].ravel(), weights=(y[part] - m[:, :, 1]).ravel(), minlength=len(lists))
            heads += m[:, 0].sum(axis=0)
            expected += np.exp(trans) * (fwd[:, :-1].reshape(-1, 2).T @ (emit[:, 1:] * bwd[:, 1:]).reshape(-1, 2))
        grads = [np.bincount(flat, weights=by_word[owner], minlength=len(w)), first - heads, pairs - expected]
        for x, g, h in zip((w, start, trans), grads, sums, strict=True):
            g = g / len(y) - L2 * x
            h += g * g
            x += RATE * g / np.sqrt(h)
    return Crf(w, start, trans)


def windows_of(words: list[str], bad: list[bool]) -> tuple[list[str], list[int]]:
    """Tokens and tags of the windows that follow each other over the whole text; the last is filled up."""
    fill = -len(words) % WINDOW if words else WINDOW
    return words + [""] * fill, [int(b) for b in bad] + [0] * fill


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, parts: int = 3, which: int = 1) -> Crf | None:
    """The field learnt from labels of rows that are not held out; None without toxic labels."""
    sample = labelled_sample(docs, labels, "toxic", parts, which, {0: MOST_CLEAN, 1: MOST_TOXIC}, scratch)
    sample = without_copies(sample, scratch)
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return None
    counted = sample.select("text", "y").mapInArrow(tidy(_count), "feature string, n0 long, n1 long")
    counted = counted.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    top = candidates(counted, n.get(0, 0), n[1]).collect()
    clean = {r.feature: r.n0 for r in top}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sorted({f for w in set(_words(t)) for f in features(w)} & clean.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.list_(pa.string()))], ["found"])

    toxic = sample.where("y = 1").select("text").mapInArrow(tidy(found), "found array<string>").collect()
    words = {f for f in clean if not f.endswith("*")}
    seeds = words | set(cover([r.found for r in toxic if words.isdisjoint(r.found)], clean, n.get(0, 0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words(text)
                bad = [not seeds.isdisjoint(features(w)) for w in words]
                tokens, tags = windows_of(words, bad)
                out[0].append(" ".join(tokens))
                out[1].append(bytes(tags if y else len(tags)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["words", "tags"])

    rows = sample.select("text", "y").mapInArrow(tidy(cut), "words string, tags binary").collect()
    rows.sort()
    index: dict[str, int] = {}
    ids = np.concatenate([np.array([index.setdefault(w, len(index)) for w in r.words.split(" ")], np.int32) for r in rows])
    y = np.concatenate([np.frombuffer(r.tags, np.int8) for r in rows])
    crf = train(list(index), ids.reshape(-1, WINDOW), y.reshape(-1, WINDOW))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Emissions(crf)
        for batch in batches:
            x = [x.tolist() for _, part in _runs(batch.column(0), known) for x in part[0]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.select("text", "y").mapInArrow(tidy(pool), "x array<double>, y int").collect()
    rows.sort()
    crf.pool = logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows]))
    return crf


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) / 100 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * len(x) / 100 * w)
    return w


def pooled(p: np.ndarray) -> np.ndarray:
    """What the suspicious marginals of a document add up to."""
    top = np.sort(p)[::-1][:2].tolist() + [0.0, 0.0]
    nor = -np.log1p(-np.minimum(p, 1 - 1e-6)).sum()
    return np.array([min(nor, 12.0), np.log1p(nor), top[0], top[1], np.log1p((p >= 0.3).sum()), 1.0])


def marginals(e: np.ndarray, first: np.ndarray, crf: Crf) -> np.ndarray:
    """Toxic marginals of a run of documents; ``first`` marks their first tokens.

    The run is cut into lanes.  Lanes are carried along side by side: their transfer matrices come
    first, then the messages that enter them one after another, then all messages.
    """
    n = len(e)
    lanes = max(1, min(4096, n // 64))
    length = -(-n // lanes)
    emit, head = np.ones(lanes * length), np.ones(lanes * length, bool)
    emit[:n], head[:n] = np.exp(np.clip(e, -30, 30)), first
    emit, head = np.ascontiguousarray(emit.reshape(lanes, length).T), np.ascontiguousarray(head.reshape(lanes, length).T)
    a, s = np.exp(crf.trans), np.exp(crf.start)

    def forward(t: int, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = x0 + x1
        y0 = np.where(head[t], s[0] * total, x0 * a[0, 0] + x1 * a[1, 0])
        y1 = np.where(head[t], s[1] * total, x0 * a[0, 1] + x1 * a[1, 1]) * emit[t]
        return y0, y1

    def backward(t: int, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Message of token t to the one before it; nothing passes a document's first token."""
        x1 = x1 * emit[t]
        y0, y1 = a[0, 0] * x0 + a[0, 1] * x1, a[1, 0] * x0 + a[1, 1] * x1
        total = x0 + x1
        return np.where(head[t], total, y0), np.where(head[t], total, y1)

    def run(step, order: range, lane_order: range, keep_before: bool) -> tuple[np.ndarray, np.ndarray]:
        one, zero = np.ones(lanes), np.zeros(lanes)
        p, q = (one, zero), (zero, one)
        for t in order:
            p, q = step(t, *p), step(t, *q)
            total = p[0] + p[1] + q[0] + q[1]
            p, q = (p[0] / total, p[1] / total), (q[0] / total, q[1] / total)
        x0, x1 = np.empty(lanes), np.empty(lanes)
        u, v = 0.5, 0.5
        for k in lane_order:
            x0[k], x1[k] = u, v
            u, v = p[0][k] * u + q[0][k] * v, p[1][k] * u + q[1][k] * v
            u, v = u / (u + v), v / (u + v)
        got0, got1 = np.empty((length, lanes)), np.empty((length, lanes))
        for t in order:
            if keep_before:
                got0[t], got1[t] = x0, x1
            x0, x1 = step(t, x0, x1)
            total = x0 + x1
            x0, x1 = x0 / total, x1 / total
            if not keep_before:
                got0[t], got1[t] = x0, x1
        return got0, got1

    f0, f1 = run(forward, range(length), range(lanes), False)
    b0, b1 = run(backward, range(length - 1, -1, -1), range(lanes - 1, -1, -1), True)
    odds1 = f1 * b1
    return np.ascontiguousarray((odds1 / (f0 * b0 + odds1)).T).ravel()[:n]


class _Emissions(dict):
    def __init__(self, crf: Crf):
        super().__init__()
        self.crf = crf

    def __missing__(self, token: bytes) -> float:
        words = _words(token)
        value = max(map(self.crf.emission, words)) if words else self.crf.emission("")
        if len(token) <= 64:
            self[token] = value
        return value


def probability(x: np.ndarray, crf: Crf) -> float:
    return float(1 / (1 + np.exp(-np.clip(x @ crf.pool, -30, 30)))) if crf.pool is not None else 0.0


def tagged(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """doc_id, score, spans (start, end, marginal; code points) of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {kind}, score double, spans array<struct<start:int,end:int,marginal:double>>"
    if crf is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<start:int,end:int,marginal:double>>)").alias("spans"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Emissions(crf)
        for batch in batches:
            for at, (x, spans) in _runs(batch.column(1), known):
                scores = [probability(v, crf) for v in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "score", "spans"])

    return rows.mapInArrow(tidy(run), schema)


def _runs(column: pa.Array, known: _Emissions) -> Iterator[tuple[int, tuple[list[np.ndarray], list[list[dict]]]]]:
    """First place, and ``pooled`` and spans of each text, for runs of about ``_BATCH_TOKENS`` tokens."""
    texts: list[bytes] = []
    e: list[np.ndarray] = []
    at = total = 0
    for i, text in enumerate(column):
        if len(known) > _CACHE:
            known.clear()
        texts.append(text.as_py() or b"")
        words = texts[-1].split()
        e.append(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
        total += len(words)
        if total >= _BATCH_TOKENS or i + 1 == len(column):
            yield at, _tagged_run(texts, e, known.crf)
            at, total, texts, e = i + 1, 0, [], []


def _tagged_run(texts: list[bytes], e: list[np.ndarray], crf: Crf) -> tuple[list[np.ndarray], list[list[dict]]]:
    ends = np.cumsum([len(x) for x in e])
    begins = np.concatenate(([0], ends[:-1]))
    out, spans = [pooled(np.empty(0))] * len(texts), [[] for _ in texts]
    if not ends[-1]:
        return out, spans
    first = np.zeros(ends[-1], bool)
    first[begins[begins < ends]] = True
    p = marginals(np.concatenate(e), first, crf)
    odd = np.flatnonzero(p >= SUSPICIOUS)
    owner = np.searchsorted(ends, odd, side="right")
    for d in np.unique(owner):
        tokens = odd[owner == d]
        out[d] = pooled(p[tokens])
        bad = {int(i - begins[d]): float(p[i]) for i in tokens if p[i] >= 0.5}
        if bad:
            byte, chars = 0, 0
            for k, m in enumerate(_TOKEN.finditer(texts[d])):
                if k in bad:
                    chars += len(texts[d][byte : m.start()].decode("utf-8", "replace"))
                    wide = len(m[0].decode("utf-8", "replace"))
                    spans[d].append({"start": chars, "end": chars + wide, "marginal": bad[k]})
                    byte, chars = m.end(), chars + wide
    return out, spans


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxic"))
    return tagged(docs, crf).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans",
    )


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, with all columns of ``docs``, null and blank texts among them; without toxic labels, and
    on an empty table, all stay."""
    crf = fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxicstage"))
    if crf is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = _Emissions(crf), names.index("text")
        for batch in batches:
            runs = _runs(batch.column(at).cast(pa.binary()), known)
            good = [probability(v, crf) < THRESHOLD for _, (x, _) in runs for v in x]
            yield batch.filter(pa.array(good, pa.bool_()))

    names = docs.columns
    return docs.mapInArrow(tidy(keep), docs.schema)
