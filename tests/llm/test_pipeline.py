"""The registered queries against their SQL, and the pipeline stage by stage."""

import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from indexalg.llm import queries
from indexalg.llm.decontamination import contamination
from indexalg.llm.ngram_jaccard_join import jaccard_components
from indexalg.llm.shared import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_one_query_per_operator():
    numbers = [re.match(r"op(\d+)_", n) for n in __spark_entry__.queries()]
    assert sorted(int(m[1]) for m in numbers if m) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stages(spark, tmp_path):
    docs, kept = table(spark, DATA, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    first, second, third, fourth, last = kept
    assert 0 < second.count() <= first.count() <= 200
    classes = {r.doc_id: r.component_id for r in jaccard_components(first).collect()}
    assert {r.doc_id for r in second.collect()} == set(classes.values())
    left = contamination(third, table(spark, DATA, "benchmark")).collect()
    assert left and not any(r.contaminated for r in left)
    assert all(n in (1, 2) for n in Counter(r.doc_id for r in fourth.collect()).values())
    assert last.count() == fourth.count()
    assert sorted((r.doc_id, r.text) for r in last.collect()) == sorted((r.doc_id, r.text) for r in fourth.collect())
    slots = sorted((r.shard, r.slot) for r in last.collect())
    assert slots == [(s, k) for s, n in sorted(Counter(s for s, _ in slots).items()) for k in range(n)]


def test_stages_take_any_column_names(spark):
    names = ["keep", "expected_grade", "tail_probability", "near_id", "near_first", "mix_draw", "size", "Target", "taken", "epoch", "repeat", "shard", "slot"]
    docs = table(spark, DATA, "documents").limit(60)
    docs = docs.select("*", *(F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert rows and (k == 4 or out.columns == docs.columns)
        assert all(r[f"{n}_" if k == 4 and n in ("size", "shard", "slot") else n] == f"{n} {r.doc_id}" for r in rows for n in names)


def test_stages_take_odd_documents(spark):
    rows = [(1, None, "en", "a", None), (None, "x y", None, None, 3), (2, "", "en", "b", 0), (2, "", "en", "b", 0), (3, "w " * 50_000, "de", "a", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, DATA)
            assert out.count() <= 2 * frame.count()
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == [0, 1, 2, 3]
