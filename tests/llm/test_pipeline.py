from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from passagix.llm.common import settled
from passagix.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = settled(stage(spark, docs, DATA), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] == counts[2] >= counts[3]
    fill = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fill) <= 2048


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an extra column with a clashing name; then no document at all."""
    rows = [(i, f"some words of document {i} line\nanother line {i} here\nthe same line again for all", "en", "ab"[i % 2], 60, i) for i in range(40)]
    rows += [(None, None, None, None, None, None), (90, "", "en", "a", 0, 1), (91, "word " * 30000, "en", None, 150000, 1), (3, rows[3][1], "en", "b", 60, 3), (92, "\n \n", None, "b", 3, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, place int"
    for name, data in (("odd", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        columns = docs.columns
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = settled(f(spark, docs, at), stage)
            assert docs.columns == columns
            if stage == "line_dedup":
                texts = [r["text"] for r in docs.collect()]
                assert sum("the same line again" in (t or "") for t in texts) <= 2 and len(texts) == len(data)
        packed = corpus_pipeline.run(spark, at).collect()
        assert (len(packed) > 0) == (len(data) > 0)
