import numpy as np
import pytest
from pyspark.sql import functions as F

from passagix.operators import acl, postings, vectors
from passagix.plans.search import Search, check
from passagix.sources import encoding, store, tables
from passagix.streaming import ingest


def test_corpus_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, "a"), (3, "ü")], "doc_id long, text string")
    for numbers in (True, False):
        path = str(tmp_path / f"c{numbers}")
        tables.write_corpus(d, path, numbers)
        assert sorted(map(tuple, tables.read_corpus(spark, path).collect())) == [(1, "a"), (2, "b"), (3, "ü")]
    assert [r["doc_id"] for r in tables.read_corpus(spark, path, limit=2).collect()] == [1, 2]


def test_queries_and_judgments(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"7": "what", "8": "who"}')
    (tmp_path / "r.json").write_text('{"7": {"1": 3, "2": 0}, "8": {"1": 1}}')
    assert sorted(map(tuple, tables.read_queries(spark, str(tmp_path / "q.json")).collect())) == [(7, "what"), (8, "who")]
    q = tables.read_qrels(spark, str(tmp_path / "r.json"))
    assert sorted(map(tuple, q.collect())) == [(7, 1, 3), (7, 2, 0), (8, 1, 1)]
    second = spark.createDataFrame([(7, 1, 1)], "qid long, doc_id long, grade int")
    assert sorted(map(tuple, tables.combined(q, second, ["qid", "doc_id"]).collect())) == [(7, 1, 1), (7, 2, 0), (8, 1, 1)]


def test_access_files(spark, tmp_path):
    a = spark.createDataFrame([(1, ["viewer", "admin"])], "doc_id long, roles array<string>")
    tables.write_acl(a, str(tmp_path / "acl"))
    assert [tuple(r) for r in tables.read_acl(spark, str(tmp_path / "acl")).collect()] == [(1, ["admin", "viewer"])]


def test_manifest_and_damage(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    path = str(tmp_path / "t")
    first = store.save(d, path, {"k": 1})
    assert store.valid(spark, path) and store.load(spark, path).count() == 2
    assert store.save(d.orderBy(F.desc("doc_id")), path)["digest"] == first["digest"]
    d.limit(1).write.mode("append").parquet(path)
    assert not store.valid(spark, path)
    with pytest.raises(store.Damaged):
        store.load(spark, path)
    assert not store.valid(spark, str(tmp_path / "none"))


def test_upsert_keeps_the_last(spark, tmp_path):
    path = str(tmp_path / "s")
    store.upsert(spark, path, spark.createDataFrame([("c0", 0, "x"), ("c1", 1, "y")], "chunk_id string, passage_id long, text string"), ["chunk_id"])
    store.upsert(spark, path, spark.createDataFrame([("c0", 0, "z"), ("c2", 0, "w")], "chunk_id string, passage_id long, text string"), ["chunk_id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("c0", 0, "z"), ("c1", 1, "y"), ("c2", 0, "w")]
    keys = spark.createDataFrame([("c1",), ("c9",)], "chunk_id string")
    assert tables.lookup(spark.read.parquet(path), keys, "chunk_id").count() == 1
    assert tables.lookup(spark.read.parquet(path), keys, "chunk_id", True).count() == 2


def test_results_are_never_changed(spark, tmp_path):
    from datetime import UTC, datetime

    now = datetime(2026, 1, 2, tzinfo=UTC)
    path = store.write_result(spark, str(tmp_path), "bm25", {"k1": 1.2}, {"ndcg": 0.5}, now)
    assert path.endswith(store.result_name("bm25", {"k1": 1.2}, now))
    with pytest.raises(FileExistsError):
        store.write_result(spark, str(tmp_path), "bm25", {"k1": 1.2}, {}, now)


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(1, "red fox"), (2, "red dog dog"), (3, "")], "doc_id long, text string")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    ingest.add_to_index(ingest.passages(spark, str(tmp_path / "in"), 1), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    index, lens, stats = ingest.index(spark, str(tmp_path / "ix"))
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, postings.postings(d).collect()))
    assert stats.first()["n_docs"] == 3 and lens.count() == 3


def test_encoding(spark):
    def model(texts):
        return np.array([[len(t), t.count("a") + 1.0] for t in texts])

    d = spark.createDataFrame([(1, "aaa"), (2, None)], "doc_id long, text string")
    rows = {r["vec_id"]: r["embedding"] for r in encoding.encode(d, model, "mini", 2).collect()}
    assert np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6) and rows[2] == pytest.approx([0, 1])


def test_search(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox", "green dog", "red dog"])], "doc_id long, text string")
    lens = postings.lengths(d)
    v = vectors.as_vectors(spark.createDataFrame([(i, [float(i % 2), float(i // 2)]) for i in range(4)], "vec_id long, embedding array<double>"))
    model = vectors.fixed_centroids(v, 2)
    assigned = vectors.assign(v, model)
    book = vectors.fixed_codebook(assigned, 2, 1, 2, 2)
    s = Search(spark, postings.postings(d), lens, postings.corpus_stats(lens), vectors.encode(assigned, book), model, book, acl.generate(d))
    assert [r["doc_id"] for r in s.search("red fox", "bm25", 2)] == [0, 1]
    dense = s.search("red", "dense", 4, embedding=[1.0, 1.0], nprobe=2)
    assert {r["doc_id"] for r in dense} == {0, 1, 2, 3} and [r["score"] for r in dense] == sorted((r["score"] for r in dense), reverse=True)
    for mode in ("hybrid", "alpha"):
        assert {r["doc_id"] for r in s.search("red fox", mode, 4, "admin", embedding=[0.0, 0.0], nprobe=2)} >= {0, 1, 3}
    assert s.search("red fox", "bm25", 2, "stranger") == []
    assert {r["stage"] for r in s.latencies().collect()} == {"bm25_retrieval", "vector_search", "fusion", "acl_filter", "full_query"}
    half = Search(spark, s.postings, s.lengths, s.stats)
    assert half.ready()["bm25"] and not half.ready()["hybrid"]
    assert half.search("red", "bm25", 2, "admin") != [] and half.search("red", "bm25", 2, "viewer") == []
    with pytest.raises(RuntimeError):
        half.search("red", "hybrid", embedding=[0.0, 0.0])
    for bad in (("",), ("x", "other"), ("x", "bm25", 0), ("x", "bm25", 1, 513)):
        with pytest.raises(ValueError):
            check(*bad)
