"""Stored indexes, drivers, spans, gates."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagix.operators import acl, bm25, metrics, postings, vectors
from passagix.plans import build, evaluation
from passagix.plans.search import Search
from passagix.plans.tracing import Tracer
from passagix.sources import store, tables


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = [f"term{i}" for i in range(40)]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(3, 25)))) for i in range(60)], "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(120)], "vec_id long, embedding array<double>").cache()


@pytest.fixture(scope="module")
def folder(spark, corpus, embeddings, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    build.lexical(corpus, at)
    build.vector_index(embeddings, at, nlist=4, m=4, codes=8, nprobe=3)
    build.access(corpus, at)
    return at


def test_built_postings_equal_postings_and_lengths(spark, corpus):
    index = postings.built(corpus)
    assert sorted(map(tuple, index.select("term", "doc_id", "tf").collect())) == sorted(map(tuple, postings.postings(corpus).collect()))
    more = corpus.unionByName(spark.createDataFrame([(900, None), (901, "the of")], "doc_id long, text string"))
    assert sorted(map(tuple, postings.lengths_of(postings.built(more), more).collect())) == sorted(map(tuple, postings.lengths(more).collect()))


def test_a_stored_index_scores_as_a_fresh_one(spark, corpus, folder):
    q = spark.createDataFrame([(1, "term1 term2 term2"), (2, "term9 none")], "qid long, text string")
    lens = postings.lengths(corpus)
    fresh = bm25.retrieve(postings.postings(corpus), lens, postings.corpus_stats(lens), bm25.query_terms(q), 5)
    s = Search.load(spark, folder)
    stored = bm25.retrieve(s.postings, None, s.stats, bm25.query_terms(q), 5)
    row = lambda r: (r["qid"], r["rank"], r["doc_id"], round(r["score"], 9))
    assert sorted(map(row, fresh.collect())) == sorted(map(row, stored.collect()))
    flat = bm25.retrieve(s.postings, None, s.stats, bm25.query_terms(q), 3, scorer=lambda tf, dl, avgdl, rare: tf * 1.0)
    best = flat.where("qid = 1 and rank = 1").first()
    counts = {r["doc_id"]: r["text"].split() for r in corpus.collect()}
    assert best["score"] == max(t.count("term1") + 2 * t.count("term2") for t in counts.values())


def test_tables_are_made_once_for_each_state_of_their_files(spark, tmp_path):
    path, made = str(tmp_path / "in"), []

    def make():
        made.append(1)
        return spark.read.parquet(path).selectExpr("x + 1 as y")

    spark.range(3).withColumnRenamed("id", "x").write.parquet(path)
    assert sorted(r["y"] for r in store.remembered("t", [path], spark, make).collect()) == [1, 2, 3]
    store.remembered("t", [path], spark, make)
    assert len(made) == 1
    spark.range(5).withColumnRenamed("id", "x").write.mode("append").parquet(path)
    assert store.remembered("t", [path], spark, make).count() == 8 and len(made) == 2


def test_an_upsert_that_was_cut_off_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda *r: spark.createDataFrame(r, "k string, v long")
    store.upsert(spark, path, rows(("a", 1), ("b", 2)), ["k"])
    (tmp_path / "s").rename(tmp_path / "s.old")
    store.recover(spark, path)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "s").rename(tmp_path / "s.old")
    store.upsert(spark, path, rows(("b", 3)), ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3)] and not (tmp_path / "s.old").exists()


def test_a_damaged_vector_index_is_made_anew(spark, embeddings, tmp_path):
    at, emb = str(tmp_path / "ix"), str(tmp_path / "emb")
    store.save(embeddings, emb)
    settings = {"nlist": 4, "m": 4, "codes": 8, "nprobe": 3}
    _, made = build.sound_vector_index(spark, emb, at, **settings)
    again, remade = build.sound_vector_index(spark, emb, at, **settings)
    assert made and not remade and again.nprobe == 3
    q = vectors.as_vectors(embeddings).where("vec_id % 40 = 0")
    want = sorted(map(tuple, again.search(q, 5).select("qid", "rank", "doc_id").collect()))
    spark.createDataFrame([(1, [0] * 4)], "vec_id long, codes array<int>").write.mode("append").parquet(f"{at}/codes/cell=0")
    with pytest.raises(store.Damaged):
        build.load_vector_index(spark, at)
    mended, remade = build.sound_vector_index(spark, emb, at, **settings)
    assert remade and mended.codes.count() == 120
    assert sorted(map(tuple, mended.search(q, 5).select("qid", "rank", "doc_id").collect())) == want
    with pytest.raises(ValueError):
        build.vector_index(embeddings, at, m=5)


def test_encoded_corpus_counts(spark, corpus, tmp_path):
    model = lambda texts: np.array([[len(t), 1.0] for t in texts])
    said = build.encoded_corpus(corpus, model, "mini", 2, str(tmp_path / "v"))
    assert said["meta"] == {"model": "mini", "dim": 2, "count": 60} and store.valid(spark, str(tmp_path / "v"))
    with pytest.raises(Exception, match="the model gave"):
        build.encoded_corpus(corpus, lambda texts: np.ones((1, 2)), "mini", 2, str(tmp_path / "w"))
    assert store.manifest(spark, str(tmp_path / "w")) is None


def test_search_starts_with_what_it_has(spark, folder, tmp_path):
    whole = Search.load(spark, folder)
    assert all(whole.ready().values()) and not whole.missing
    part = Search.load(spark, str(tmp_path / "nothing"))
    assert not any(part.ready().values()) and set(part.missing) == {"postings", "lengths", "stats", "codes", "model", "codebook", "access"}


def test_spans(spark, folder, tmp_path):
    t = Tracer()
    with pytest.raises(KeyError), t.span("bad", "q" * 500, top_k=3):
        raise KeyError("x")
    t.record("known", 12.5, "q")
    assert [s.name for s in t.spans] == ["bad", "known"] and len(t.spans[0].query) == 200 and t.spans[0].attributes == {"top_k": 3, "error": "KeyError"}
    assert t.export(spark, str(tmp_path / "spans.jsonl")) == 2 and t.spans == []
    lines = [json.loads(x) for x in (tmp_path / "spans.jsonl").read_text().splitlines()]
    assert lines[1] == {"name": "known", "query": "q", "duration_ms": 12.5, "attributes": {}}
    s = Search.load(spark, folder, encoder=lambda texts: np.ones((len(texts), 16)), check=False)
    s.search("term1 term2", "hybrid", 3, "admin")
    assert [x.name for x in s.tracer.spans] == ["dense_encode", "bm25_retrieval", "vector_search", "fusion", "acl_filter", "full_query"]
    assert s.tracer.spans[1].attributes["results"] <= 12


def test_one_request_equals_the_batch(spark, folder):
    s = Search.load(spark, folder, check=False)
    e = [0.5] * 16
    asked = spark.createDataFrame([(0, "term1 term5", e)], "qid long, text string, embedding array<double>")
    for mode, role in (("bm25", None), ("dense", "viewer"), ("hybrid", "sales"), ("alpha", "admin")):
        want = [(r["doc_id"], round(r["score"], 9)) for r in s.run(asked, mode, 5, role, 4).orderBy("rank").collect()]
        assert [(r["doc_id"], round(r["score"], 9)) for r in s.search("term1 term5", mode, 5, role, 4, e)] == want


def test_drivers_write_results(spark, corpus, embeddings, folder, tmp_path):
    out = str(tmp_path)
    s = Search.load(spark, folder, check=False)
    queries = spark.createDataFrame([(1, "term1 term2"), (2, "term7")], "qid long, text string")
    qrels = spark.createDataFrame([(1, 3, 2), (1, 8, 1), (2, 5, 3)], "qid long, doc_id long, grade int")
    one = evaluation.evaluate_bm25(s, queries, qrels, out, 20, baseline=0.0)
    assert one["metrics"]["gate"]["passed"] and set(one["metrics"]["per_query"]) == {"1", "2"}
    assert not evaluation.evaluate_bm25(s, queries, qrels, out, 20, k1=1.5, baseline=2.0)["metrics"]["gate"]["passed"]
    assert json.loads(open(one["path"]).read())["metrics"]["ndcg_10"] == one["metrics"]["ndcg_10"]
    q = vectors.as_vectors(embeddings).where("vec_id in (1, 2)")
    dense = evaluation.evaluate_dense(s, q, qrels, out, 50, 4, (1, 4))
    assert [x["nprobe"] for x in dense["metrics"]["sweep"]] == [1, 4] and dense["metrics"]["sweep"][0]["recall"] <= dense["metrics"]["sweep"][1]["recall"]
    lexical = bm25.retrieve(s.postings, None, s.stats, bm25.query_terms(queries), 50)
    hybrid = evaluation.evaluate_hybrid(spark, lexical, vectors.ivf_pq(q, s.codes, s.model, s.codebook, 4, 50), qrels, out)["metrics"]
    assert hybrid["gate"]["passed"] == (hybrid["ablation"]["rrf"]["ndcg_10"] > hybrid["ablation"]["dense"]["ndcg_10"]) and len(hybrid["sweep"]) == 11
    assert hybrid["ablation"]["best_alpha"]["ndcg_10"] == pytest.approx(max(x["ndcg_10"] for x in hybrid["sweep"]))
    cost = evaluation.evaluate_acl(spark, lexical, s.access, qrels, out, k=10)["metrics"]
    assert cost["admin"]["drop"] == 0 and set(cost) == {*acl.SHARES, "unrestricted"}
    lat = evaluation.evaluate_latency(s, ["term1", "term2"], out, "bm25", 3, "admin", limit=1e9)["metrics"]
    assert lat["stages"]["bm25_retrieval"]["n"] == 2 and lat["gate"]["passed"]
    small = evaluation.evaluate_quantisation(embeddings, q, qrels, out, 4, 4, 50, ("m4", "m8", "sq8"))["metrics"]
    assert [small[v]["bytes_a_vector"] for v in ("m4", "m8", "sq8")] == [4, 8, 16]


def test_load(spark, folder):
    s = Search.load(spark, folder, check=False)
    pool = tables.query_pool(spark, None, ["term1", "term2"])
    got = evaluation.load_test(s, pool, 6, 2, True, embeddings={"term1": [0.1] * 16})
    # term2 has no vector, and there is no encoder: vector modes fail for it and are counted.
    assert got["requests"] == 6 and sum(got["errors"].values()) + sum(m["n"] for m in got["modes"].values()) == 6 and set(got["errors"]) <= {"RuntimeError"}
    with pytest.raises(RuntimeError):
        evaluation.load_test(Search(spark), pool, 1)


def test_query_pool_reads_a_file(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"2": "b", "1": "a"}')
    assert tables.query_pool(spark, str(tmp_path / "q.json"), ["z"]) == ["a", "b"]
    assert tables.query_pool(spark, str(tmp_path / "none.json"), ["z"]) == ["z"]


def test_judgments_hash_does_not_depend_on_order(spark):
    q = spark.createDataFrame([(1, 5, 2), (1, 4, 1), (2, 9, 0)], "qid long, doc_id long, grade int")
    h = evaluation.qrels_hash(q)
    assert h == evaluation.qrels_hash(q.orderBy(F.desc("doc_id")).repartition(3)) and len(h) == 64
    assert h != evaluation.qrels_hash(q.where("grade > 0"))


def test_gates(spark):
    means = spark.createDataFrame([("a", 0.5), ("b", 0.38)], "system string, ndcg double")
    got = {r["system"]: r["passed"] for r in metrics.gates(means, {"a": 0.4, "b": 0.4, "c": 0.1}, 0.01).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_categories(spark):
    rows = spark.createDataFrame([(1, 0.2), (2, 0.4), (3, 0.9), (4, 0.1)], "qid long, ndcg double")
    kinds = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "qid long, category string")
    got = [tuple(r) for r in metrics.by_category(rows, kinds).collect()]
    assert [g[0] for g in got] == ["uncategorised", "x", "y", "all"] and got[1][2] == pytest.approx(0.3) and got[3][1] == 4


def test_places_are_exact(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([-3.0, 0.0, 0.1, 5.0, 1e9, rng.random()])) for _ in range(500)] + [(None, 2.0), ("b", -1.0), ("b", None)]
    got = {r["k"]: r for r in metrics.latency(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    for k in ("a", "b", None):
        v = sorted(x for kk, x in rows if kk == k and x is not None)
        assert (got[k]["n"], got[k]["p50"], got[k]["p95"], got[k]["p99"]) == (len(v), *(v[min(int(len(v) * p), len(v) - 1)] for p in (0.5, 0.95, 0.99)))
        assert got[k]["mean"] == pytest.approx(sum(v) / len(v))


def test_bootstrap_of_a_metric(spark):
    rows = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(40)], "qid long, hit double, one double")
    ratio = lambda x: x.groupBy("round").agg((F.sum("hit") / F.sum("one")).alias("m"))
    a, b = metrics.bootstrap(rows, "hit", 100).first(), metrics.bootstrap(rows, "hit", 100, metric=ratio).first()
    assert tuple(a) == pytest.approx(tuple(b)) and 0.2 < a["low"] < 0.5 < a["high"] < 0.8


def test_queries_beyond_what_is_sent_meet_vectors_in_blocks(spark, embeddings):
    v = vectors.as_vectors(embeddings)
    q = v.where("vec_id % 10 = 0")
    row = lambda df: sorted(map(tuple, df.select("qid", "rank", "doc_id").collect()))
    assert row(vectors.exact_knn(q, v, 3)) == row(vectors.exact_knn(q, v, 3, sent=500))


def test_posting_blocks(spark):
    ids = [0, 3, 127, 65535, 65536, 65537, 200_000, 1 << 40]
    index = spark.createDataFrame([("a", i) for i in ids] + [("b", 5)], "term string, doc_id long")
    blocks = postings.vbyte_blocks(index)
    assert blocks.where("term = 'a'").count() == 4
    assert sorted(map(tuple, postings.from_vbyte_blocks(blocks).collect())) == [*(("a", i) for i in ids), ("b", 5)]
    from passagix.functions import vbyte

    sizes = {r["term"]: (r["n_postings"], r["n_bytes"]) for r in postings.vbyte_sizes(index).collect()}
    assert sizes == {"a": (8, len(vbyte.encode_sorted(ids))), "b": (1, 1)}
