"""Steps whose work or memory must not grow faster than their input, against the plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagix.functions import vbyte
from passagix.operators import bm25, chunking, fusion, metrics, postings, vectors


def texts(spark, n=60, words=25, seed=5):
    rng = random.Random(seed)
    rows = [" ".join(rng.choices([f"w{i}" for i in range(words)], k=rng.randint(0, 40))) for _ in range(n)]
    return spark.createDataFrame([*enumerate(rows), *((n + i, rows[1] + " w1 w2 w3 w4 w5 w6 w7") for i in range(9)), (n + 20, None), (n + 21, "")], "doc_id long, text string")


def test_counted_documents(spark, monkeypatch):
    d = texts(spark)
    monkeypatch.setattr(postings, "AT_ONCE", 50)
    rows = postings.counted(d.coalesce(1)).collect()
    assert {r["doc_id"]: dict(zip(r["terms"], r["tfs"])) for r in rows if r["doc_id"] < 80} == {r["doc_id"]: {w: (r["text"] or "").split().count(w) for w in (r["text"] or "").split()} for r in d.where("doc_id < 80").collect()}
    assert {r["doc_id"]: r["dl"] for r in rows} == {r["doc_id"]: len((r["text"] or "").split()) for r in d.collect()}
    twice = postings.postings(d.unionByName(d))
    assert sorted(map(tuple, twice.collect())) == sorted((t, i, 2 * n) for t, i, n in postings.postings(d).collect())


def test_many_queries_without_pairs(spark, monkeypatch):
    """No pair of query and document is moved, results are those of retrieve, and copies score the same to the last bit."""
    d = texts(spark)
    monkeypatch.setattr(bm25, "BLOCK", 7)
    index, counts, terms = postings.built(d), postings.counted(d.repartition(3)), bm25.query_terms(d, "doc_id", "text")
    want = bm25.top_k(bm25.score_batch(index, postings.lengths(d), postings.corpus_stats(postings.lengths(d)), terms).where("qid != doc_id"), 5)
    key = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    for asked in (bm25.ASKED, 40):
        got = bm25.retrieve_counted(counts, terms, 5, skip_self=True, asked=asked)
        assert key(got) == key(want)
    assert not bm25.retrieve_counted(counts, terms.limit(0), 5).collect()
    copies = bm25.retrieve_counted(counts, terms.where("qid = 60"), 9)
    assert copies.select("score").distinct().count() == 1
    assert [r["score"] for r in fusion.minmax(fusion.legs(copies)).select("score").distinct().collect()] == [1.0]


def test_judgments_by_class_are_the_pairs(spark):
    rng = random.Random(8)
    items = spark.createDataFrame([(i, rng.choice([1, 2, 3, None]) if i else 9, rng.randint(0, 3)) for i in range(40)], "doc_id long, label int, grade int")
    queries = items.where("doc_id % 4 = 0").select(F.col("doc_id").alias("qid"), "label")
    pairs = queries.join(items, "label").where("qid != doc_id").select("qid", "doc_id", "grade")
    run = spark.createDataFrame([(q, d, r, s) for q in range(0, 48, 4) for s in ("a", "b") for r, d in enumerate(rng.sample(range(44), 12), 1)], "qid long, doc_id long, rank int, system string")
    classes = metrics.ByClass(items, queries)
    for f in (
        lambda q: metrics.dcg(run, q, 5, ["system"]), lambda q: metrics.idcg(q, 5), lambda q: metrics.ndcg_by_query(run, q, 5, ["system"]), lambda q: metrics.mrr_by_query(run, q, 5), lambda q: metrics.dataset_stats(q),
        lambda q: metrics.recall_by_query(run, q, 8, ["system"]), lambda q: metrics.recall_by_query(run, q, 8, keep_empty=True, threshold=2), lambda q: metrics.per_query(run.where("system = 'a'"), q),
    ):
        a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(q).collect()) for q in (pairs, classes))
        assert a == b and a


def test_searches_without_pairs(spark, monkeypatch):
    """Blocks of any size find what the distances say, ties to the smaller id, to the last bit of a sum in order."""
    rng = random.Random(4)
    rows = [(i, [rng.randint(-3, 3) / 3 for _ in range(4)]) for i in range(150)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    q = v.where("vec_id % 10 = 0")
    model = vectors.fixed_centroids(v, 5)
    assigned = vectors.assign(v, model).cache()
    cell = {r["vec_id"]: r["cell"] for r in assigned.collect()}
    book = vectors.fixed_codebook(assigned, 16, 2, 8, 4)
    codes = vectors.encode(assigned, book)
    at = dict(rows)

    def l2(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s += (x - y) * (x - y)
        return s

    near = {i: sorted(range(5), key=lambda c: (round(l2(at[i], at[c]), 9), c)) for i in range(0, 150, 10)}
    of = {r["vec_id"]: r["codes"] for r in codes.collect()}
    books = book.first()[0]

    def pq(i, d):
        r = [x - y for x, y in zip(at[i], at[cell[d]])]
        return sum((l2(r[2 * j : 2 * j + 2], books[j][of[d][j]]) for j in range(2)), 0.0)

    def best(i, distance, docs, k):
        return [(i, r, d, distance(i, d)) for r, d in enumerate(sorted(docs, key=lambda d: (round(distance(i, d), 9), d))[:k], 1)]

    got = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], r["distance"]) for r in df.collect())
    for block, asking, sent in ((4096, 1024, 1 << 20), (7, 4, 300)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "ASKING", asking)
        flat = lambda i, d: l2(at[i], at[d])
        assert got(vectors.exact_knn(q, v, 6, skip_self=True, sent=sent)) == [x for i in near for x in best(i, flat, set(at) - {i}, 6)]
        assert got(vectors.ivf_flat(q, assigned, model, 2, 6)) == [x for i in near for x in best(i, flat, [d for d in at if cell[d] in near[i][:2]], 6)]
        assert got(vectors.ivf_pq(q, codes, model, book, 2, 6)) == [x for i in near for x in best(i, pq, [d for d in at if cell[d] in near[i][:2]], 6)]
    qrels = spark.createDataFrame([(i, d, 1) for i in near for d in range(i % 7, 150, 7)], "qid long, doc_id long, grade int")
    swept = {r["nprobe"]: r["recall"] for r in vectors.nprobe_sweep(q, codes, model, book, qrels, [1, 3], 20).collect()}
    for n, recall in swept.items():
        hits = [sum(x[2] % 7 == i % 7 for x in best(i, pq, [d for d in at if cell[d] in near[i][:n]], 20)) / len(range(i % 7, 150, 7)) for i in near]
        assert abs(recall - sum(hits) / len(hits)) < 1e-9


def test_chunks_by_id(spark):
    d = texts(spark)
    chunks = chunking.chunk_passages(d, 10, 4)
    ids = ["3_0", "3_1", "3_1", "5_0", "5_99", "81_0", "7_01", "x_0", "_", "3_99999999999", "900_0"]
    wanted = spark.createDataFrame([(i,) for i in ids], "chunk_id string")
    got = chunking.chunks_of(d, wanted, 10, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.join(wanted, "chunk_id").select(*got.columns).collect()))
    assert not [n for n in str(got._jdf.queryExecution().optimizedPlan()).split("\n") if "Join" in n and "chunk_id" in n]  # texts meet ids uncut


def test_posting_codes_in_batches(spark):
    rng = random.Random(2)
    rows = [(t, i) for t in ("a", "b", "c d") for i in rng.sample([*range(300), *range(65400, 65800), 1 << 40], 400)] + [("z", 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        blocks = postings.vbyte_blocks(spark.createDataFrame(rows, "term string, doc_id long"))
        lists = {}
        for t, i in sorted(rows):
            lists.setdefault((t, i >> 16), []).append(i & 65535)
        assert {(r["term"], r["block"]): (r["n"], bytes(r["code"])) for r in blocks.collect()} == {k: (len(x), vbyte.encode_sorted(x)) for k, x in lists.items()}
        assert sorted(map(tuple, postings.from_vbyte_blocks(blocks).collect())) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not postings.vbyte_blocks(spark.createDataFrame([], "term string, doc_id long")).collect()
    assert "Aggregate" not in blocks._jdf.queryExecution().optimizedPlan().toString()  # no list is gathered


def test_gaps():
    rng = random.Random(1)
    n = np.array([rng.randrange(1 << rng.randint(1, 62)) for _ in range(500)] + [0, 127, 128, 1 << 62], np.int64)
    data, sizes = vbyte.encode_gaps(n)
    assert bytes(data) == b"".join(vbyte.encode(int(x)) for x in n) and sizes.tolist() == [len(vbyte.encode(int(x))) for x in n]
    back, end = vbyte.decode_gaps(data)
    assert back.tolist() == n.tolist() and end.tolist() == np.cumsum(sizes).tolist()
    with pytest.raises(ValueError):
        vbyte.encode_gaps(np.array([3, -1]))
