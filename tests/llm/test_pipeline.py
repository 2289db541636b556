"""The pipeline stage by stage on the smallest tables, against what each stage promises."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from junctura.llm import batches, op3_jaccard_join, op6_sentencepiece, op7_pii

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = spark.createDataFrame([(10**6, "12 !!", "en", "src0", 5), (10**6 + 1, None, "en", "src0", 0), (10**6 + 2, docs.orderBy("doc_id").first().text, "en", "src0", 1)], docs.schema)
    held, columns = docs.unionByName(more), docs.columns
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, FOLDER)
        if name != "encoding":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        frames[name] = held = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id for r in frames["language_id"].select("doc_id").collect()}
    assert 10**6 not in kept and 10**6 + 1 not in kept and 10**6 + 2 in kept
    assert len(kept) == docs.count() + 1
    rows = frames["near_copies"].collect()

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(r.text) for r in rows]
    assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert 10**6 + 2 not in {r.doc_id for r in rows}
    assert frames["personal_data"].count() == len(rows)
    assert all(not [s for s in op7_pii.spans_of(r.text) if s[0] != "url"] and r.n_chars == len(r.text) for r in frames["personal_data"].collect())
    times = [r["count"] for r in frames["mixing"].groupBy("doc_id").count().collect()]
    assert set(times) <= {1, 2}
    coded = frames["encoding"]
    assert coded.count() == frames["mixing"].count() and coded.filter(~F.col("round_trip")).count() == 0


def test_workers_let_go_of_what_others_keep():
    lattice = op6_sentencepiece.lattice_of(open(op6_sentencepiece.MODEL, "rb").read(), 4)
    lattice.encode("some words to remember")
    held = op6_sentencepiece.lattice_of.cache_info
    list(batches.lighter(iter, keeps=op6_sentencepiece.lattice_of)(iter([1])))
    assert held().currsize == 1
    assert list(batches.lighter(iter)(iter([1, 2]))) == [1, 2]
    assert held().currsize == 0


def test_overlaps_are_counted_once(spark, tmp_path):
    """A filter on an overlap isn't pushed below it: two rounds of Python in a stage would count twice, in twice as many workers."""
    spark.createDataFrame([(1, 2, 10, 10)], "a long, b long, na long, nb long").write.parquet(f"{tmp_path}/pairs")
    spark.createDataFrame([(i, *[bytes(range(10))] * op3_jaccard_join.FRAGMENTS) for i in (1, 2)], ", ".join(["node long", *[f"{x} binary" for x in op3_jaccard_join.SEGMENTS]])).write.parquet(f"{tmp_path}/segments")
    counted = op3_jaccard_join._counted(spark.read.parquet(f"{tmp_path}/pairs"), spark.read.parquet(f"{tmp_path}/segments"), op3_jaccard_join.SEGMENTS[:2])
    out = counted.filter("9 * o >= na").select("a", "b", "o")
    assert [tuple(r) for r in out.collect()] == [(1, 2, 4)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_texts_are_replaced_in_parts(spark):
    texts = [None, "", "mail a.b@c.org now"] * 300
    parts = list(op7_pii._masked(iter([pa.array(texts, pa.string()), pa.array([], pa.string())])))
    assert max(map(len, parts)) <= op7_pii.TOGETHER
    assert [t for p in parts for t in p.to_pylist()] == [None, "", "mail [EMAIL] now"] * 300
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "text long, body string, n long").repartition(2)
    out = op7_pii.redact_pii(df, "body")
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(i, op7_pii.redacted(t), i) for i, t in enumerate(texts)]
