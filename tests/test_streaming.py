import random

import pytest

from ringlet.operators import decode
from ringlet.streaming.live import advanced, live_graphs


def test_live_graphs_equal_decoding(spark, tmp_path):
    """Letters in three micro-batches, in any order within each, one of them twice."""
    rng = random.Random(9)
    words = {i: "".join(rng.choice(decode.ALPHABET) for _ in range(30 + i)) for i in range(4)}
    for part, (lo, hi) in enumerate([(0, 10), (10, 21), (20, 99)]):
        rows = [(i, k, w[k]) for i, w in words.items() for k in range(lo, min(hi, len(w)))]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "graph_id long, place long, letter string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={part}")
    stream = spark.readStream.schema("graph_id long, place long, letter string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = live_graphs(stream).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.graph_id: r for r in spark.sql("SELECT * FROM live ORDER BY n_letters").collect()}
    want = decode.graphs(spark.createDataFrame(list(words.items()), "id long, w string"))
    for r in want.select("id", "w", "n", decode.distinct_edges().alias("e")).collect():
        assert (got[r.id].n_letters, got[r.id].n_nodes, got[r.id].n_edges) == (len(r.w), r.n, len(r.e))
    spark.sql("DROP VIEW IF EXISTS live")


def test_invalid_letters_are_refused():
    with pytest.raises(ValueError):
        advanced([0], 0, 0, 1, {}, "X")
