import random
from array import array

import numpy as np
import pytest

from ringlet.llm import byte_bpe, hnsw, pii, quality, sharding, toxicity, url_filter
from ringlet.llm.common import Scratch


def test_bpe_equals_tiktoken():
    import public_tokenizers
    import tiktoken

    path, pattern = byte_bpe.tokenizer_file()
    ranks = byte_bpe.load_ranks(path)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, rng = byte_bpe.ByteBPE(ranks, pattern), random.Random(1)
    texts = ["", "a" * 5000, "<|endoftext|>", " \n\t x"] + ["".join(rng.choice("abthe in.\n0é漢") for _ in range(200)) for _ in range(200)]
    for t in texts:
        ids = ours.encode(t)
        assert list(array("I", ids)) == theirs.encode_ordinary(t) and ours.decode(ids) == t.encode()


def test_bpe_of_nulls(spark):
    frame = spark.createDataFrame([(1, None, 5), (None, "", 6)], "doc_id long, text string, ids int")
    assert [r.n_tokens for r in byte_bpe.digests(frame, *byte_bpe.tokenizer_file()).collect()] == [0, 0]


def test_shards_are_even_and_gapless(spark):
    rows = [(i % 190, None if i % 17 == 0 else "x" * (i % 50), i) for i in range(1000)] + [(None, "n" * k, 1) for k in range(50)]
    out, _ = sharding.shard_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, slot long"))
    pdf = out.toPandas()
    for _, g in pdf.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = pdf.groupby("shard")["size"].sum()
    assert len(pdf) == 1050 and sums.max() <= 1.1 * sums.min()


def test_rebalancing_edits_the_map():
    rng = random.Random(2)
    weights = [rng.randrange(1, 100) for _ in range(512)]
    old = sharding.fit_map(weights, 8)
    new = sharding.rebalance(old, weights, 9)
    moved = [v for v in range(512) if old.shards[v] != new.shards[v]]
    assert new.version == 2 and all(new.shards[v] == 8 for v in moved) and max(new.loads()) < 1.05 * sum(weights) / 9


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("HTTP://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"), ("x://org/fr/a", "org", "/fr/a", "org/fr/", "allow"),
    ("http://n.net", "n.net", "", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None),
])
def test_urls(spark, url, host, path, rule, verdict):
    r = url_filter.judged(spark.createDataFrame([(1, url, "z")], "page_id long, url string, host string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ((verdict,) if verdict else ("allow", "block"))


def test_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:400] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [1.0, None])]
    frame = hnsw.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert frame.count() == 600
    got = hnsw.nearest(hnsw.build_index(frame, Scratch(spark, "t"), 200), frame.where("vec_id % 50 = 0")).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        assert g["rank"].tolist() == list(range(1, 11))
        hit += len(set(want) & set(g.vec_id))
    assert hit >= 0.9 * len(got) and len(got) == 120


def test_personal_data(spark):
    rows = [(1, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.1.1"), (2, "+1 (523) 555-1055, 4111 1111 1111 1111; 4111111111111112"), (3, None), (4, "1" * 100_000 + "a" * 100_000)]
    got = {r.doc_id: r for r in pii.supervised(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1].base] == [("email", 0, 5), ("email", 5, 11), ("ip", 12, 19), ("ip", 20, 27)]
    assert [s.kind for s in got[2].base] == ["card", "phone"] and got[3].base == [] and got[4].base == []


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(2)
    crf = toxicity.Crf(np.zeros(1), np.array([0.3, -1.0]), np.array([[0.5, -1.0], [-0.2, 0.4]]))
    lengths = [1, 300, 7, 1000]
    e, first = rng.normal(size=sum(lengths)), np.zeros(sum(lengths), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    want = np.concatenate([toxicity._chains(x[None], crf.start, crf.trans)[3][0, :, 1] for x in np.split(e, np.cumsum(lengths)[:-1])])
    assert np.allclose(toxicity.marginals(e, first, crf), want)


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.tagged(docs, toxicity.fit(docs, labels, Scratch(spark, "t"))).collect()} == {0.0}
    assert {r.score for r in quality.scored(docs, quality.fit(docs, labels, Scratch(spark, "t"))).collect()} == {0.5}


def test_full_piece_cache_and_text_sql(monkeypatch):
    """A full cache gives the same ids; SQL is text, of known queries."""
    from ringlet.llm import queries

    ours = byte_bpe.ByteBPE(byte_bpe.load_ranks(byte_bpe.tokenizer_file()[0]), byte_bpe.tokenizer_file()[1])
    text = " ".join(f"w{i * 7919 % 613}x" for i in range(900))
    want = ours.encode(text)
    monkeypatch.setattr(byte_bpe, "CACHED", 5)
    fresh = byte_bpe.ByteBPE(ours.ranks, byte_bpe.tokenizer_file()[1])
    assert fresh.encode(text) == want and len(fresh.known) <= 5
    assert all(isinstance(x, str) and k in queries.QUERIES for k, x in queries.ORACLE_SQL.items())


def test_toxic_stems_may_occur_in_clean_texts(spark):
    """A stem in 80 % of toxic and 10 % of clean texts is a toxic one, whatever the class ratio of the sample."""
    rng = random.Random(4)
    common = ["apple", "river", "stone", "cloud", "table", "green", "music", "paper", "light", "house"]
    for n_clean in (300, 900):
        rows = []
        for i in range(150 + n_clean):
            words = rng.choices(common, k=20)
            if rng.random() < (0.8 if i < 150 else 0.1):
                words[rng.randrange(20)] = "grumbolt"
            rows.append((i, " ".join(words), int(i < 150)))
        docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        crf = toxicity.fit(docs, docs.select("doc_id", "toxic"), Scratch(spark, "t"))
        score = {r.doc_id: r.score for r in toxicity.tagged(docs, crf).collect()}
        having = {i for i, text, _ in rows if "grumbolt" in text}
        assert min(score[i] for i in having) > max(score[i] for i in score.keys() - having)


def test_the_field_is_trained_on_whole_texts(spark):
    rows = [(i, " ".join([*["grumbolt"] * (9 * (i % 2)), *(f"{'ct'[i % 2]}{i}w{k}" for k in range(150))]), i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    crf, scratch = toxicity.fit(docs, docs.select("doc_id", "toxic"), Scratch(spark, "t")), Scratch(spark, "t")
    sample = toxicity.labelled_sample(docs, docs.select("doc_id", "toxic"), "toxic", 3, 1, {0: 99, 1: 99}, scratch).collect()
    assert len(sample) > 9 and all(crf.weights[toxicity.hashed(w)[1]] != 0 for r in sample for w in r.text.decode().split())


def test_repeated_queries_and_copies(spark):
    """A repeated row asks once, an id on two vectors twice, and many copies under the query's id hide no others."""
    x = np.random.default_rng(3).normal(size=(40, 8)).round(3)
    rows = [(i, x[i]) for i in range(40)] + [(0, x[0])] * 2 + [(10, x[39])] + [(20, x[20])] * 14 + [(i, x[20]) for i in range(50, 53)]
    frame = hnsw.usable(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>"))
    got = hnsw.nearest(hnsw.build_index(frame, Scratch(spark, "t")), frame.where("vec_id IN (0, 10, 20)"))
    want = []
    for q, v in ((0, x[0]), (10, x[10]), (10, x[39]), (20, x[20])):
        near = sorted((float(np.sqrt(((u - v) ** 2).sum())), j) for j, u in rows if j != q)[:10]
        want += [(q, k, j, round(s, 9)) for k, (s, j) in enumerate(near, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_bpe_remembers_many_pretokens(monkeypatch):
    path, pattern = byte_bpe.tokenizer_file()
    bpe, merged = byte_bpe.ByteBPE(byte_bpe.load_ranks(path), pattern), []
    monkeypatch.setattr(bpe, "merge", lambda piece: merged.append(piece) or [0])
    for _ in range(2):
        for k in range(300_000):
            bpe.known[str(k)]
    assert len(merged) == 300_000


def test_bpe_remembers_in_little_memory():
    """Two generations of pre-tokens take under 70 bytes each, and each still gets its own ids."""
    import tracemalloc
    from types import SimpleNamespace

    merged = []
    bpe = SimpleNamespace(merge=lambda piece: merged.append(0) or list(piece[-3:]))
    tracemalloc.start()
    known, n = byte_bpe._Pieces(bpe), 2 * byte_bpe.CACHED
    for k in range(n):
        known[f" é{k:07d}"]
    used = tracemalloc.get_traced_memory()[0] - merged.__sizeof__()
    tracemalloc.stop()
    assert used < 70 * n
    assert all(list(array("I", known[f" é{k:07d}"])) == list(f"{k:07d}".encode()[-3:]) for k in range(n - 1000, n)) and len(merged) == n


def test_bpe_bounds_what_it_remembers_in_bytes():
    from types import SimpleNamespace

    known = byte_bpe._Pieces(SimpleNamespace(merge=lambda piece: [1] * len(piece)))
    for k in range(60_000):
        known[f"{'漢' * 42}{k:06d}"]
    assert 0 < known.old.count < 60_000 and len(known.old.records) < byte_bpe.CACHED_BYTES + 1000
