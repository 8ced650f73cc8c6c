"""Every query and the pipeline on small tables with odd rows, against plain versions; and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ringlet.llm import byte_bpe, mixing, pii, quality, queries, sharding, toxicity, url_filter
from ringlet.llm.common import Scratch, table

COMMON = "apple river stone cloud table green music paper light house winter garden letter window market bridge island forest silver copper".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _digest string, score double, shard int, token string"


def documents():
    """Odd rows, then 90 texts of which a third bear a toxic stem, with exact and near copies."""
    rng = random.Random(11)
    rows = [(1000, None, "a"), (1001, "", "a"), (1002, " \n\t ", None), (1003, "one", "b"), (1004, "One", "b"), (1005, "é É", None), (1006, "mail me at ann@example.org or 10.0.0.1, +49 30 1234567 4111 1111 1111 1111", "b"),
            (1006, "mail me at ann@example.org or 10.0.0.1, +49 30 1234567 4111 1111 1111 1111", "b"), (1007, "word " * 30_000, "c"), (1008, "x" * 40_000, "c"), (None, "no number here", "a"), (None, "no number here", "a")]
    made = []
    for i in range(90):
        words = rng.choices(COMMON, k=rng.randrange(30, 90))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "grumbolt" + rng.choice(["", "s", "ing"])
        if i % 2:
            words += ["!!!", "||"] * 8
        made.append(" ".join(words))
    rows += [(i, t, "abc"[i % 5 % 3]) for i, t in enumerate(made)]
    rows += [(200 + i, made[i].upper(), "a") for i in range(1, 90, 9)]
    rows += [(300 + i, made[i] + " tail", "b") for i in range(2, 90, 9)]
    return [(i, t, "en", s, len(t or ""), "d", 0.5, 1, "t") for i, t, s in rows]


def written(spark, path, docs, labels, vectors, pages):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, extra string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, dim int, shard int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string, host string, verdict string").write.parquet(f"{path}/pages.parquet")
    return str(path)


URLS = [None, "", "no scheme", "http://a.NET/x", "http://example.net/en/1", "http://www.example.net/EN/1", "ftp://example.com/de/a?b#c", "http://example.com/fr/", "https://x.org/fr/9#?", "https://org/fr/", "http://example.com",
        "http://win.example.com?x=/de/", "x://://y/z", "http://é.org/ä", "https://www.casino-win.example.com/en/1", "https://www.library.example.com/en/1", "http://a.net/x"] + ["http://example.com/" + "a/" * 20_000]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    docs = documents()
    labels = [(i, int(i % 2 == 0), int(i % 3 == 0), "e") for i in range(90)] + [(3, None, 1, "e"), (None, 1, 1, "e"), (5, 7, 9, "e")]
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).astype(float).tolist(), 1, 0, 0) for i in range(80)] + [(100, None, 1, 0, 0), (200, [0.0] * 6, 1, 0, 0), (300, [1.0, 2.0], 1, 0, 0), (None, [1.0] * 6, 1, 0, 0)]
    vectors += [vectors[0], vectors[7]]
    pages = [(i, u, "<p>", "h", "v") for i, u in enumerate(URLS)] + [(None, URLS[3], None, None, None)]
    return written(spark, tmp_path_factory.mktemp("odd"), docs, labels, vectors, pages)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def rows_of(spark, odd, name):
    return queries.QUERIES[name](spark, odd).collect()


def texts(spark, odd):
    return [(r.doc_id, r.text) for r in table(spark, odd, "documents").collect()]


def held(doc_id, parts, which):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % parts == which


def test_op1_equals_a_plain_version(spark, odd):
    weights, constant = url_filter.train([(*url_filter._split(u), y) for u, y in url_filter.labelled_urls()])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = rows_of(spark, odd, "op1_url_ngrams")
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[r.page_id if r.page_id is not None else 3]
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate(lower)
        fits = [rule for rule, _ in url_filter.RULES if (host == rule.split("/", 1)[0] or host.endswith("." + rule.split("/", 1)[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        grams = [g for kind, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in range(2, 6) for g in {url_filter.xxhash.xxh3_64_intdigest(kind + t[i : i + n]) & 0xFFFF for i in range(len(t) - n + 1)}]
        score = 1 / (1 + math.exp(-(sum(weights[g] for g in grams) / math.sqrt(len(grams)) + constant)))
        verdict = dict(url_filter.RULES)[rule] if rule else "block" if score >= 0.5 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict) and r.block_score == pytest.approx(score)


def test_op1_learns_hosts_and_paths(spark):
    urls = ["http://www.example.com/casino-win", "http://www.example.com/library", "https://example.org/en/free-bets/7.html", "https://example.org/en/museum/7.html", "http://www.casino-win.example.com/en/12",
            "http://www.library.example.com/en/12", "https://library.example.org/casino-win/", "https://library.example.org/museum/", "https://casino-win.example.org/museum/"]
    got = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.block_score >= 0.5 for r in got] == [True, False, True, False, True, False, True, False, True]


def folded(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_op2_equals_a_plain_version(spark, odd):
    by = {}
    for i, t in texts(spark, odd):
        by.setdefault(folded(t), []).append(i)
    want, stay = [], Counter()
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        stay[keep] += 1
    got = rows_of(spark, odd, "op2_exact_stream")
    key = lambda r: repr(r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(by) and Counter(r.doc_id for r in got if r.kept) == stay


def plain_spans(text):
    """Base matches by Python's own engine, without possessive parts; places are code points."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(patterns[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_op3_equals_a_plain_version(spark, odd):
    want = {}
    for i, t in texts(spark, odd):
        spans = plain_spans(t)
        want.setdefault(i, []).append((*(sum(k == kind for k, *_ in spans) for kind in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), [f"{k}:{a}:{b}" for k, a, b in spans]))
    got = {}
    for r in rows_of(spark, odd, "op3_weak_pii"):
        got.setdefault(r.doc_id, []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans))
    for i, rows in want.items():
        assert sorted(x[:5] for x in rows) == sorted(x[:5] for x in got[i])
        assert all(set(rows[0][5]) <= set(filter(None, g[5].split(","))) for g in got[i])


def test_op3_estimates_and_classifier():
    """Expectation-maximisation against a plain version on single candidates; reliabilities come out as they were put in."""
    rng = random.Random(3)
    counts = Counter()
    for _ in range(4000):
        true = rng.random() < 0.6
        vote = lambda yes, no: ("+" if rng.random() < yes else "0") if true else ("-" if rng.random() < no else "0")
        counts[("0" + vote(0.9, 0.8) + vote(0.8, 0.9) + vote(0.7, 0.5) + vote(0.2, 0.7) + "s" + "w" + "1", True if true and rng.random() < 0.9 else False)] += 1
    prior, tables, post = pii.reliabilities(dict(counts))
    assert abs(prior - 0.6) < 0.03 and abs(tables[0]["+"][1] - 0.9) < 0.04 and abs(tables[1]["-"][0] - 0.9) < 0.04
    rows = [k for k, n in counts.items() for _ in range(n)]
    cast = {k: [*k[0][1:5], "+" if k[1] else "0"] for k in counts}
    p = {k: 0.95 if k[1] else 1 / (1 + math.exp(-sum({"+": 1, "0": 0, "-": -1.5}[v] for v in cast[k]) + 0.5)) for k in counts}
    for _ in range(pii.STEPS):
        share = (sum(p[k] for k in rows) + 1) / (len(rows) + 2)
        odds = {k: math.log(share / (1 - share)) for k in counts}
        for j in range(5):
            for k in counts:
                chances = []
                for y in (0, 1):
                    weight = lambda r, y=y: p[r] if y else 1 - p[r]
                    mine = sum(counts[r] * weight(r) for r in counts if cast[r][j] == cast[k][j]) + 0.5
                    chances.append(mine / (sum(counts[r] * weight(r) for r in counts) + 1.5))
                odds[k] += math.log(chances[1] / chances[0])
        p = {k: 1 / (1 + math.exp(-max(-30, min(30, odds[k])))) for k in counts}
    assert all(post[k] == pytest.approx(p[k], abs=1e-6) for k in counts)
    scores = pii.classifier(dict(counts), post)
    right = sum(n for k, n in counts.items() if (scores[k[0]] >= 0.5) == (post[k] >= 0.5))
    assert right > 0.9 * sum(counts.values())


def test_op3_adds_announced_spans(spark):
    rows = [(i, f"please call our phone {i % 700 + 200}-555-{1000 + i % 9000} today, mail bob{i}@site.org") for i in range(60)] + [(100 + i, f"part number {i % 90 + 10}0.555.{1000 + i} in section {i}=") for i in range(40)]
    got = {r.doc_id: r for r in pii.supervised(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert sum(any(s.kind == "phone" for s in got[i].added) for i in range(60)) >= 50 and sum(bool(got[100 + i].added) for i in range(40)) <= 5


def test_op4_equals_brute_force(spark, odd):
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, odd, "embeddings").collect() if r.vec_id is not None and r.embedding and any(r.embedding)]
    got = rows_of(spark, odd, "op4_hnsw_shards")
    want = []
    for q in {i for i, _ in vectors if i % 100 == 0}:
        v = next(x for i, x in vectors if i == q)
        near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in vectors if i != q and len(x) == len(v))[:10]
        want += [(q, k, i, pytest.approx(s)) for k, (s, i) in enumerate(near, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want, key=lambda x: x[:3])


def test_op5_equals_tiktoken(spark, odd):
    import public_tokenizers
    import tiktoken

    path, pattern = byte_bpe.tokenizer_file()
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = []
    for i, t in texts(spark, odd):
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: repr(r)
    assert sorted([tuple(r) for r in rows_of(spark, odd, "op5_byte_bpe")], key=key) == sorted(want, key=key)


def test_a_rank_file_without_a_byte_is_refused():
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.ByteBPE({bytes([b]): b for b in range(255)}, ".")


def test_op6_equals_a_plain_version(spark, odd):
    got = rows_of(spark, odd, "op6_virtual_slots")
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(spark, odd))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.virtual_slot, set()).add(r.shard)
    assert all(len(s) == 1 for s in slots.values())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # The map that the query used is the latest stored, an edit of the even one.
    path = sharding.map_path(spark, f"{odd}/documents")
    versions = sharding.stored_versions(spark, path)
    first, last = sharding.load_map(spark, path, 1), sharding.load_map(spark, path)
    assert versions == [1, 2] and first.shards == sharding.even_map().shards and {r.virtual_slot: r.shard for r in got} == {r.virtual_slot: last.shards[r.virtual_slot] for r in got}
    weights = [0] * sharding.N_SLOTS
    for r in got:
        weights[r.virtual_slot] += r["size"]
    assert last.weights == tuple(weights) and sharding.rebalance(first, weights).shards == last.shards
    again = rows_of(spark, odd, "op6_virtual_slots")
    assert sharding.stored_versions(spark, path) == [1, 2] and sorted(map(repr, again)) == sorted(map(repr, got))


def test_op6_rebalancing_is_even_and_moves_little(spark):
    rng = random.Random(5)
    weights = [rng.randrange(1, 2000) for _ in range(4096)]
    new = sharding.rebalance(sharding.even_map(), weights)
    assert max(new.loads()) - min(new.loads()) <= 0.002 * sum(weights) / 8
    weights[17] += 40_000
    third = sharding.rebalance(new, weights)
    moved = sum(weights[v] for v in range(4096) if new.shards[v] != third.shards[v])
    assert third.version == 3 and max(third.loads()) - min(third.loads()) <= 0.002 * sum(weights) / 8 and moved < 0.05 * sum(weights)
    hot = [1] * 4096
    hot[5] = 10**9
    assert max(sharding.rebalance(sharding.even_map(), hot).loads()) == 10**9
    rows = [(7, "same", i) for i in range(500)] + [(i, f"t{i}", 1) for i in range(200)]
    out, _ = sharding.shard_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(8))
    pdf = out.toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in pdf.groupby("shard")) and len(pdf) == 700


def test_op7_equals_a_plain_version(spark, odd):
    """Densities by their formula, with inverses and determinants instead of factors."""
    known = {i: max(y for j, y in [(r.doc_id, r.quality) for r in table(spark, odd, "labels").collect()] if j == i and y in (0, 1)) for i in range(90)}
    mine = [(i, t) for i, t in texts(spark, odd) if i in known and not held(i, 4, 2)]
    x, y = np.array([quality.statistics(t.encode()) for _, t in mine]), np.array([known[i] for i, _ in mine])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = lambda v: np.clip((v - centre) / scale, -8, 8)
    parts = [z(x)[y == k] for k in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covs, strict=True)) / len(x)

    def density(v, k):
        c = (1 - quality.SHRINK_POOLED) * covs[k] + quality.SHRINK_POOLED * pooled
        c = (1 - quality.SHRINK_DIAGONAL) * c + quality.SHRINK_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        d = z(v) - parts[k].mean(axis=0)
        return -0.5 * d @ np.linalg.inv(c) @ d - 0.5 * np.log(np.linalg.det(c))

    gap = lambda v: np.arcsinh(density(v, 1) - density(v, 0))
    link = toxicity.logistic(np.array([[gap(v), max(gap(v), 0), 1.0] for v in x]), y)
    got = rows_of(spark, odd, "op7_quadratic_quality")
    by_id = {}
    for i, t in texts(spark, odd):
        g = gap(quality.statistics((t or "").encode()))
        by_id.setdefault(i, []).append(1 / (1 + np.exp(-np.clip(np.array([g, max(g, 0), 1.0]) @ link, -30, 30))))
    assert len(got) == sum(map(len, by_id.values()))
    for r in got:
        assert min(abs(r.score - s) for s in by_id[r.doc_id]) < 1e-6 and 0 <= r.score <= 1
        assert r.held_out == held(r.doc_id, 4, 2) and r.predicted == int(r.score >= 0.7)
    right = [r.predicted == known[r.doc_id] for r in got if r.doc_id in known and r.held_out]
    assert np.mean(right) > 0.8


def plain_score(text, crf):
    """One document by the plain recursion over its own tokens."""
    words = (text or "").split()
    if not words:
        return toxicity.probability(toxicity.pooled(np.empty(0)), crf), []
    each = [re.findall(r"[^\W_]+", w.lower()) for w in words]
    e = np.array([max(map(crf.emission, x)) if x else crf.emission("") for x in each])
    p = toxicity._chains(e[None], crf.start, crf.trans)[3][0, :, 1]
    odd_ = p[p >= toxicity.SUSPICIOUS]
    return toxicity.probability(toxicity.pooled(odd_), crf), [w for w, m in zip(words, p, strict=True) if m >= 0.5]


def test_op8_equals_a_plain_version(spark, odd):
    docs = table(spark, odd, "documents")
    crf = toxicity.fit(docs, table(spark, odd, "labels"), Scratch(spark, "t"))
    want = {}
    for i, t in texts(spark, odd):
        want.setdefault(i, []).append((*plain_score(t, crf), t))
    got = rows_of(spark, odd, "op8_toxic_crf")
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        score, bad, text = min(want[r.doc_id], key=lambda x: abs(x[0] - r.score))
        assert r.score == pytest.approx(score, abs=1e-6) and r.held_out == held(r.doc_id, 3, 1) and r.predicted == int(r.score >= 0.7)
        assert [text[s.start : s.end] for s in r.spans] == bad
    toxic = {i for i, t in texts(spark, odd) if t and "grumbolt" in t.lower()}
    assert {r.doc_id for r in got if r.predicted} == toxic


def test_op8_pooling_and_cover():
    p = np.array([0.9, 0.1, 0.4, 0.05])
    nor = -sum(math.log(1 - x) for x in p)
    assert toxicity.pooled(p).tolist() == pytest.approx([nor, math.log1p(nor), 0.9, 0.4, math.log1p(2), 1.0])
    docs, clean = [["a", "b"], ["a", "c"], ["a"], ["d"], ["d"], ["d", "b"]], {"a": 0, "b": 0, "c": 0, "d": 0}
    assert toxicity.cover(docs, clean, 10) == ["a", "d"] and toxicity.cover(docs, clean | {"d": 5}, 10) == ["a"]


def linked_groups(rows):
    """component of each row by brute force on full shingle sets."""
    sets = []
    for _, t in rows:
        w = folded(t).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                top[root(a)] = root(b)
    return sets, [root(k) for k in range(len(rows))]


def test_op9_equals_brute_force(spark, odd):
    rows = texts(spark, odd)
    sets, groups = linked_groups(rows)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        least.setdefault(g, []).append(i)
    want = []
    for (i, _), s, g in zip(rows, sets, groups, strict=True):
        ids = [x for x in least[g] if x is not None]
        want.append((i, len(s), min(ids) if s and ids else i))
    key = lambda r: repr(r)
    got = rows_of(spark, odd, "op9_circulant_minhash")
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op10_keeps_its_contract(spark, odd):
    sizes = Counter((i, len((t or "").split())) for i, t in texts(spark, odd))
    got = rows_of(spark, odd, "op10_mix_blocks")
    assert Counter((r.doc_id, r["size"]) for r in got) == sizes and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(repr, rows_of(spark, odd, "op10_mix_blocks"))) == sorted(map(repr, got))
    assert all((r.shard_bits > 0) == (r.taken > 0) for r in got)


def test_pipeline_stage_by_stage(spark, odd):
    """Each stage on what the one before kept, against plain versions; and run() as all of them."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]
    docs = table(spark, odd, "documents")
    columns, kept = docs.columns, [(r.doc_id, r.text, r.source) for r in docs.collect()]
    scratch = Scratch(spark, "stages")
    key = lambda r: repr(r)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = scratch.write(stage(spark, docs, odd), f"{k}")
        assert out.columns == columns and out.dtypes == docs.dtypes
        if name == "toxicity":
            crf = toxicity.fit(docs, table(spark, odd, "labels"), Scratch(spark, "t"))
            kept = [r for r in kept if plain_score(r[1], crf)[0] < toxicity.THRESHOLD]
        elif name == "exact dedup":
            by = {}
            for r in kept:
                by.setdefault(folded(r[1]), []).append(r)
            kept = [max(rows, key=lambda r: -1 if r[0] is None else r[0]) for rows in by.values()]
        else:
            _, groups = linked_groups([r[:2] for r in kept])
            best = {}
            for r, g in zip(kept, groups, strict=True):
                best[g] = min(best.get(g, r), r, key=lambda x: math.inf if x[0] is None else x[0])
            kept = list(best.values())
        got = sorted([(r.doc_id, folded(r.text), r.source) for r in out.collect()], key=key)
        assert got == sorted([(i, folded(t), s) for i, t, s in kept], key=key)
        docs = out
    mixed = scratch.write(corpus_pipeline.STAGES[3][1](spark, docs, odd), "3")
    assert mixed.columns == columns
    here = {r.doc_id: r for r in docs.collect()}
    taken, copies = Counter(), Counter()
    for r in mixed.collect():
        words = r.text.split()
        taken[r.source] += len(words)
        copies[r.doc_id] += len(words)
        mine = (here[r.doc_id].text or "").split()
        whole = iter(mine)
        assert all(w in whole for w in words) and r.n_chars == len(r.text) and (len(words) < len(mine) or r.text == here[r.doc_id].text)
    assert all(copies[i] <= 3 * len((here[i].text or "").split()) for i in copies)
    plan = mixing.mix(mixing.sized(docs, F.col("doc_id")), Scratch(spark, "t"))
    for r in plan.rows.select("src", "source_size", "target").distinct().collect():
        source = sorted({x.source for x in here.values()}, key=lambda s: (s is None, s))[r.src]
        assert abs(taken[source] - r.target) <= (3 + 5 * (mixing.SHARDS / 4) ** 0.5) * mixing.BLOCK or taken[source] == 3 * r.source_size
    final = corpus_pipeline.STAGES[4][1](spark, mixed, odd).collect()
    bpe = byte_bpe.codec(*byte_bpe.tokenizer_file())
    want = Counter((r.doc_id, hashlib.sha256(bpe.encode(r.text)).hexdigest()) for r in mixed.collect())
    assert Counter((r.doc_id, r.ids_sha256) for r in final) == want
    run = corpus_pipeline.run(spark, odd).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in run) == Counter((r.doc_id, r.n_tokens) for r in final)
