import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ringlet.llm import exact_dedup, mixing, near_dedup
from ringlet.llm.common import Scratch

COLUMNS = "doc_id long, text string, source string, _digest string, keep_id int"


def docs(spark, tmp_path, rows, files=1):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], COLUMNS).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


ROWS = [(1, "A b", "s"), (2, "a B", "s"), (3, None, None), (4, "", "s"), (5, "É", "t"), (6, "é", "t"), (2, "a B", "s"), (None, "z", "t")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_in_several_batches_and_with_clashing_digests(spark, tmp_path, weak):
    digest = (lambda t: F.substring(F.sha2(t, 256), 1, 1)) if weak else exact_dedup.sha256
    frame = docs(spark, tmp_path, ROWS, 3)
    got = exact_dedup.groups(frame, digest, files_per_trigger=1).collect()
    assert sorted((r._id or 0, r._keep or 0, r._size) for r in got) == [(0, 0, 1), (1, 2, 3), (2, 2, 3), (2, 2, 3), (3, 4, 2), (4, 4, 2), (5, 5, 1), (6, 6, 1)]
    assert sum(r._kept for r in got) == 5
    if not weak:
        assert {r._digest for r in got if r._id == 4} == {hashlib.sha256(b"").hexdigest()}


def test_empty_tables(spark, tmp_path):
    frame = docs(spark, tmp_path, [])
    assert exact_dedup.groups(frame).count() == 0
    assert near_dedup.grouped(frame).count() == 0
    assert mixing.mix(mixing.sized(frame, F.col("doc_id")), Scratch(spark, "t")).rows.count() == 0


def test_near_groups_match_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        words = [rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(60)]
        for _ in range(3):
            words[rng.randrange(60)] = "new" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(words), "s"))
    rows += [(500, None, "s"), (501, " \n", "s"), (502, "two words", "s"), (503, "TWO words", "s"), (504, "two words", "s")]
    sets = {}
    for i, text, _ in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[comp[i]] == comp[i] for i in comp):
            break
    got = near_dedup.grouped(docs(spark, tmp_path, rows, 2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), comp[i]) for i in sets}


def mixed(spark, tmp_path, shards=mixing.SHARDS):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(400), rng.choice(["a", "b", "c", None])) for i in range(200)] + [(900, None, "a"), (901, " \n", "b"), (7, "w w", "a"), (7, "w w", "a")]
    return rows, mixing.mix(mixing.sized(docs(spark, f"{tmp_path}/{shards}", rows), F.col("doc_id")), Scratch(spark, "t"), shards=shards)


def test_mix_keeps_to_targets(spark, tmp_path):
    """Shards draw whole shares surely and the rest by chance: a variance of at most a quarter a shard, here five deviations."""
    rows, made = mixed(spark, tmp_path)
    taken = made.pieces.groupBy("src").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("n")).alias("t"), F.max("n").alias("most"))
    target = {r.src: r.target for r in made.rows.select("src", "target").distinct().collect()}
    for r in taken.collect():
        assert r.most <= 3 and abs(r.t - target[r.src]) <= (2 + 5 * (mixing.SHARDS / 4) ** 0.5) * mixing.BLOCK
    assert abs(sum(target.values()) - sum(len((t or "").split()) for _, t, _ in rows)) < 1e-3


def test_shards_draw_their_counts(spark, tmp_path):
    """Each shard fills all its slots, no source gets less than its share rounded down, and the draw decides what is taken."""
    taken = []
    for shards in (8, 3):
        _, made = mixed(spark, tmp_path, shards)
        counts = made.counts.collect()
        wanted = {r.src: r.target * -(-r.source_size // mixing.BLOCK) / r.source_size for r in made.rows.select("src", "target", "source_size").distinct().collect()}
        total = round(sum(wanted.values()))
        by_shard = [sum(r.n for r in counts if r.shard == s) for s in range(shards)]
        assert sorted(by_shard, reverse=True) == [total // shards + (s < total % shards) for s in range(shards)]
        assert all(r.n >= int(by_shard[r.shard] * wanted[r.src] / sum(wanted.values())) for r in counts)
        taken.append({r.src: r.t for r in made.pieces.groupBy("src").agg(F.sum("n").alias("t")).collect()})
    assert taken[0] != taken[1]


def test_taken_words_match_a_plain_walk(spark, tmp_path):
    """The line, the slots and the words of each text, once more by plain loops over the drawn counts."""
    rows, made = mixed(spark, tmp_path)
    line, slots = made.rows.collect(), made.slots.collect()
    assert sorted((r.doc_id, r.size) for r in line) == sorted((i, len((t or "").split())) for i, t, _ in rows)
    got = {(r.src, r["at"]): (r.t, set(sum(r.s, []))) for r in made.pieces.groupBy("src", "at").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("n")).alias("t"), F.collect_list("shards").alias("s")).collect()}
    for src in {r.src for r in line}:
        mine = sorted((r["at"], r.size) for r in line if r.src == src and r.size)
        size = sum(n for _, n in mine)
        assert [at for at, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))]
        blocks = -(-size // mixing.BLOCK)
        counts = {r.shard: r.n for r in made.counts.where(F.col("src") == src).collect()}
        assert sum(counts.values()) == sum(1 for r in slots if r.src == src)  # none is beyond the third epoch here
        for epoch in range(sum(counts.values()) // blocks):
            assert sorted(r.block for r in slots if r.src == src and r.epoch == epoch) == list(range(blocks))
        for at, n in mine:
            words, shards = 0, set()
            for r in slots:
                if r.src == src:
                    here = range(max(at, r.block * mixing.BLOCK), min(at + n, (r.block + 1) * mixing.BLOCK))
                    words += len(here)
                    shards |= {r.shard} if len(here) else set()
            assert got.get((src, at), (0, set())) == (words, shards) and words <= 3 * n


def test_targets_stop_at_three_times_the_size(spark):
    rows = [("a", 10), ("b", 1000), (None, 1000)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert got["a"] == 30 and got["b"] == pytest.approx(1980 * 2 / 5) and got[None] == pytest.approx(1980 * 3 / 5)


def test_permutation_of_any_size(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))
