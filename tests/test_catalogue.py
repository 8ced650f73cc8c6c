import os

import duckdb
import pytest

from ringlet.operators import decode
from ringlet.plans import catalogue, relations

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def values(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(repr([None if x != x else float(x) if isinstance(x, (int, float)) else x for x in row]) for row in pdf.where(pdf.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_oracle(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_strings_cover_whole_texts(spark):
    """Plain Python over the texts gives the same strings, letter by letter, for long, empty and null ones."""
    texts = [(1, "Hello, World! " * 50), (2, ""), (3, None), (4, "123 é"), (5, "e" * 24), (6, "x" * 25)]
    docs = spark.createDataFrame(texts, "k long, text string")
    to = dict(zip(decode.FROM, decode.TO, strict=True))
    got = {}
    for r in decode.parts(docs, "k", "text", 24).orderBy("id").collect():
        got.setdefault(r.id // decode.PARTS, []).append(r.w)
    for k, text in texts:
        w = "".join(to[c] for c in (text or "").lower() if c.isascii() and c.isalpha())
        assert got[k] == ([w[i : i + 24] for i in range(0, len(w), 24)] or [""])


def test_every_letter_of_the_tables_is_read(spark):
    for name, table, key in (("strings", "documents", "doc_id"), ("bench", "benchmark", "item_id")):
        there = relations.table(spark, DATA, table).select(key, "text").toPandas().set_index(key).text.fillna("").str.count("[A-Za-z]")
        read = relations.RELATIONS[name](spark, DATA).selectExpr(f"id div {decode.PARTS} AS k", "length(w) AS l").groupBy("k").sum("l").toPandas().set_index("k")["sum(l)"]
        assert there.sort_index().tolist() == read.sort_index().tolist()


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_queries_without_sql_run(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_searches_agree_with_one_another(spark):
    """Canonical classes are those of the canonical codes when loops are left aside, and GED is 0 between no two of them."""
    found = catalogue.QUERIES["ged_of_classes"](spark, DATA).toPandas()
    assert found.certified.all() and (found.distance > 0).all() and (found.lb == found.distance).all()
    gap = catalogue.QUERIES["greedy_optimality"](spark, DATA).toPandas()
    assert (gap.gap >= 0).all()
