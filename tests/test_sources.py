import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlet.operators import decode
from ringlet.sources import graph_files, sinks, synthetic

GXL = '<?xml version="1.0"?>\n<gxl>\n<graph id="{name}" edgeids="false" edgemode="undirected">{body}</graph>\n</gxl>\n'


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def folder(tmp_path):
    node = '<node id="{}"><attr name="x"><float>1.0</float></attr></node>'
    edge = '<edge from="{}" to="{}"><attr name="weight"><int>1</int></attr></edge>'
    body = lambda names, ends: "".join(map(node.format, names)) + "".join(edge.format(*e) for e in ends)
    write(f"{tmp_path}/g/a.gxl", GXL.format(name="a", body=body("_2 _0 _1".split(), [("_0", "_1"), ("_1", "_0"), ("_2", "_2"), ("_1", "_9")])))
    write(f"{tmp_path}/g/b.gxl", GXL.format(name="b", body=body(["_0"], [])))
    write(f"{tmp_path}/g/broken.gxl", "<gxl><graph>")
    write(f"{tmp_path}/g/unlisted.gxl", GXL.format(name="u", body=body(["_0", "_1"], [("_0", "_1")])))
    index = lambda *files: "<GraphCollection><x>" + "".join(f'<print file="{f}" class="{c}"/>' for f, c in files) + "</x></GraphCollection>"
    write(f"{tmp_path}/g/train.cxl", index(("a.gxl", "A"), ("broken.gxl", "B")))
    write(f"{tmp_path}/g/test.cxl", index(("a.gxl", "Z"), ("b.gxl", "B"), ("gone.gxl", "C")))
    return f"{tmp_path}/g"


def test_gxl_and_cxl(spark, folder):
    index = graph_files.read_index(spark, [f"{folder}/train.cxl", f"{folder}/test.cxl"])
    assert index.count() == 5 and {r.file: (r.split, r.label) for r in graph_files.first_split(index).collect()}["a.gxl"] == ("train", "A")
    files = {r.id: r for r in graph_files.read_gxl(spark, folder).collect()}
    assert (files["a"].n, [(e.u, e.v) for e in files["a"].edges], files["a"].n_unknown) == (3, [(0, 1)], 1)
    assert (files["b"].n, files["b"].edges) == (1, []) and files["broken"].n is None and files["broken"].problem
    assert {(r.element, r.name, r.n_files) for r in graph_files.observed_attributes(spark, folder).collect()} == {("node", "x", 3), ("edge", "weight", 2)}
    got = graph_files.read_collection(spark, folder)
    assert {(r.id, r.label, r.split, r.n) for r in got["graphs"].collect()} == {("a", "A", "train", 3), ("b", "B", "test", 1)}
    assert [r.id for r in got["absent"].collect()] == ["gone"] and [r.id for r in got["problems"].collect()] == ["broken"]
    assert {r.id for r in graph_files.read_collection(spark, folder, "directory")["graphs"].collect()} == {"a", "b", "unlisted"}
    with pytest.raises(ValueError):
        graph_files.read_collection(spark, folder, "guess")


def test_array_files(spark, tmp_path):
    np.savez(f"{tmp_path}/c.npz", graph_ids=np.array(["x", "y", "z"]), splits=np.array(["train", "test", "test"]), labels=np.array(["A", "B", ""]), n_nodes=np.array([3, 2, 1]),
             n_edges=np.array([2, 1, 0]), edge_offsets=np.array([0, 2, 3, 3]), edges=np.array([[0, 1, 0], [1, 2, 1]]))
    rows = {r.id: r for r in graph_files.read_arrays(spark, f"{tmp_path}/c.npz").collect()}
    assert [(rows[i].n, [(e.u, e.v) for e in rows[i].edges]) for i in "xyz"] == [(3, [(0, 1), (1, 2)]), (2, [(0, 1)]), (1, [])]
    m = np.array([[0, 1, np.inf], [1, 0, -1], [np.inf, -1, 0]])
    np.savez(f"{tmp_path}/m.npz", ged_matrix=m)
    assert [(r.k, r.i, r.j, r.value) for r in sorted(graph_files.read_matrix(spark, f"{tmp_path}/m.npz", "ged_matrix").collect())] == [(0, 0, 1, 1.0), (1, 0, 2, None), (2, 1, 2, None)]
    near = spark.createDataFrame([(2.995,), (2.5,), (3.009,)], "v double").select(graph_files.whole_distance(F.col("v")).alias("v"))
    assert [r.v for r in near.collect()] == [3.0, 2.5, 3.0]
    ids = graph_files.split_ids(spark.createDataFrame([("val", 0), ("train", 1), ("train", 0)], "split string, place long"), "SET").collect()
    assert sorted((r.idx, r.id) for r in ids) == [(0, "SET_train_0000"), (1, "SET_train_0001"), (2, "SET_val_0000")]


def test_json_pair_lists_and_csv(spark, tmp_path):
    write(f"{tmp_path}/s.json", json.dumps({"strings": {"a": {"string": "VV", "length": 2}, "b": {"string": None, "length": None}}}))
    assert {(r.id, r.w) for r in graph_files.read_strings(spark, f"{tmp_path}/s.json").collect()} == {("a", "VV"), ("b", None)}
    write(f"{tmp_path}/m.json", json.dumps({"dataset": "d", "graph_ids": ["a", "b"], "labels": ["A", "B"], "node_counts": [3, 4], "edge_counts": [2, 3]}))
    assert [(r.dataset, r.idx, r.id, r.n, r.m) for r in graph_files.read_metadata(spark, f"{tmp_path}/m.json").collect()] == [("d", 0, "a", 3, 2), ("d", 1, "b", 4, 3)]
    given = spark.createDataFrame([(2, 1), (1, 2), (0, 3)], "pair_i int, pair_j int")
    assert sorted(r.k for r in graph_files.read_pair_list(given, 4).collect()) == [2, 3]
    for bad in ([(1, 1)], [(0, 9)]):
        with pytest.raises(Exception, match="pair"):
            graph_files.read_pair_list(spark.createDataFrame(bad, "pair_i int, pair_j int"), 4).collect()
    write(f"{tmp_path}/q.csv", 'a,b\n"x, ""y""","line\nend"\n')
    assert graph_files.read_quoted_csv(spark, f"{tmp_path}/q.csv").collect() == [('x, "y"', "line\nend")]
    write(f"{tmp_path}/t.csv", "graph,n,method,seconds\ng,3,greedy,0.5\n")
    assert graph_files.read_timings(spark, f"{tmp_path}/t.csv").first().seconds == 0.5
    assert graph_files.source_root([f"{tmp_path}/none", str(tmp_path)], "q.csv") == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        graph_files.source_root([f"{tmp_path}/none"], "q.csv")


EDGES = "id long, n int, edges array<struct<u:int,v:int>>"


def test_cohorts_and_digests(spark, tmp_path):
    rows = [(1, 3, [(0, 1), (1, 2)]), (2, 2, [(0, 1)])]
    frame = spark.createDataFrame(rows, EDGES)
    made = sinks.write_cohort(frame, f"{tmp_path}/c", 2)
    assert made["content_sha256"] == sinks.content_digest(spark.createDataFrame(rows[::-1], EDGES).repartition(3))
    assert made["content_sha256"] != sinks.content_digest(spark.createDataFrame([*rows, rows[0]], EDGES))
    assert graph_files.manifest(f"{tmp_path}/c.manifest.json") == made and json.loads(sinks.read_text(spark, f"{tmp_path}/c.manifest.json")) == made
    for bad in ([(1, 2, [(1, 0)])], [(1, 2, [(0, 2)])], [(1, 2, [(0, 1), (0, 1)])], [(1, 1, []), (1, 1, [])]):
        with pytest.raises(ValueError):
            sinks.write_cohort(spark.createDataFrame(bad, EDGES), f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        sinks.write_cohort(frame, f"{tmp_path}/bad", 3)
    assert not os.path.exists(f"{tmp_path}/bad")
    sinks.write_text(spark, f"{tmp_path}/x.txt", "abc")
    assert sinks.file_digest(spark, f"{tmp_path}/x.txt").first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert sinks.read_text(spark, f"{tmp_path}/none.txt") is None


def test_matrices_strings_and_traces(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1, 2.0), (1, 0, 2, None), (2, 1, 2, 1.0)], "k long, i int, j int, value double")
    for method in ("lev", "ged"):
        sinks.write_matrix(rows, f"{tmp_path}/m", "d", method)
    assert graph_files.methods_of(spark, f"{tmp_path}/m") == ["ged", "lev"]
    got = graph_files.read_artifacts(spark, f"{tmp_path}/m", "d").orderBy("k").collect()
    assert [(r.k, r.lev, r.ged) for r in got] == [(0, 2.0, 2.0), (1, None, None), (2, 1.0, 1.0)]
    with pytest.raises(ValueError):
        sinks.write_matrix(spark.createDataFrame([(0, 1, 0, 2.0)], rows.schema), f"{tmp_path}/m", "d", "x")
    words = spark.createDataFrame([(1, "VVPnC"), (2, None)], "id long, w string")
    sinks.write_strings(words, f"{tmp_path}/s")
    assert {(r.id, r.string, r.length) for r in spark.read.json(f"{tmp_path}/s").collect()} == {(1, "VVPnC", 5), (2, None, None)}
    steps = decode.trace(words.where("w IS NOT NULL"))
    sinks.write_trace(steps, f"{tmp_path}/t")
    back = graph_files.read_trace(spark, f"{tmp_path}/t").orderBy("step").collect()
    assert [(r.step, r.ring, r.created_u, r.n_edges) for r in back] == [(r.step, r.ring, r.created_u, r.n_edges) for r in steps.orderBy("step").collect()]


def test_shards(spark, tmp_path):
    target = spark.range(10).withColumnRenamed("id", "k")
    rows = target.selectExpr("k", "k * 2D AS value")
    assert sinks.unfinished(target, f"{tmp_path}/s").count() == 10
    for part in range(2):
        sinks.write_shard(rows.where(f"k % 3 = {part}"), f"{tmp_path}/s", part, target)
        sinks.write_shard(rows.where(f"k % 3 = {part}"), f"{tmp_path}/s", part, target)
    assert sorted(r.k for r in sinks.unfinished(target, f"{tmp_path}/s").collect()) == [2, 5, 8]
    with pytest.raises(ValueError, match="another set"):
        sinks.unfinished(target.where("k < 5"), f"{tmp_path}/s")
    shards = graph_files.read_shards(spark, f"{tmp_path}/s")
    assert shards.count() == 7 and graph_files.read_shards(spark, f"{tmp_path}/s", (shards.first().shard,)).count() < 7
    with pytest.raises(ValueError, match="3 pairs missing"):
        sinks.merge_shards(shards, 10)
    whole = rows.unionByName(rows.where("k < 4"))
    assert sinks.merge_shards(whole, 10).where("copies = 2").count() == 4
    with pytest.raises(ValueError, match="1 disagree"):
        sinks.merge_shards(rows.unionByName(spark.createDataFrame([(3, 1.0)], "k long, value double")), 10)
    assert sinks.fingerprint(target) == sinks.fingerprint(target.unionByName(target).repartition(3))
    with pytest.raises(ValueError):
        graph_files.role_rows(rows, "lb")
    assert graph_files.role_rows(rows.withColumnRenamed("value", "ub"), "ub").columns == ["k", "ub"]


def test_report_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a_1", 1.0, 2), ("b", 0.5, None)], "name string, r double, n int")
    assert sinks.markdown(rows).split("\n")[2] == "| a_1 | 1.000 | 2 |"
    text = sinks.latex(rows, largest=("r",), smallest=("n",))
    assert r"\textbf{1.000}" in text and r"\textbf{2}" in text and text.count("&") == 6
    sinks.write_pair_csv(rows, f"{tmp_path}/p")
    assert spark.read.option("header", True).csv(f"{tmp_path}/p").count() == 2
    sinks.write_json(rows, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_synthetic_sources(spark):
    for name, sizes in synthetic.FAMILIES.items():
        for n in (sizes[0], sizes[-1]):
            e = synthetic.family(name, n)
            assert e == synthetic.family(name, n) and len(set(e)) == len(e) and all(0 <= u < v < n for u, v in e) and synthetic.joined(n, e) == sorted(e)
    assert len(synthetic.complete(5)) == 10 and synthetic.grid(9)[:2] == [(0, 1), (1, 2)] and len(synthetic.grid(9)) == 12 and len(synthetic.attached(10, 2)) == 2 + 7 * 2
    assert len(synthetic.random_tree(9)) == 8 and len(synthetic.small_world(10, 4, 0.3)) == 20 and synthetic.small_world(10, 2, 0.0) == sorted(synthetic.cycle(10))
    assert all(len(set(synthetic.edited(6, synthetic.cycle(6), k)) ^ set(synthetic.cycle(6))) == k for k in range(1, 6))
    assert len(synthetic.relabelled(6, synthetic.cycle(6), 1)) == 6 and (0, 0) in synthetic.with_loops(3, [], 1.0)
    rows = synthetic.families(spark, ["gnp_05", "path"], 2).collect()
    assert len(rows) == 2 * 18 * 2 and all([(e.u, e.v) for e in r.edges] == synthetic.family(r.family, r.n, 42, r.instance) for r in rows)
    assert synthetic.density_sweep(spark, 5, (0.2, 0.8), 3).count() == 6
    strings = synthetic.random_strings(spark, 50, 12).collect()
    assert strings == synthetic.random_strings(spark.newSession(), 50, 12).repartition(3).orderBy("id").collect() and max(len(r.w) for r in strings) <= 12
    with pytest.raises(ValueError):
        synthetic.family("none", 3)
    assert synthetic.fixtures(spark).count() == len(synthetic.FIXTURES)
