import math
import random

import pytest
from pyspark.sql import functions as F

from passagix.operators import acl, bm25, chunking, fusion, metrics, postings, vectors


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_chunks(spark):
    n = 25
    d = docs(spark, " ".join(f"tok{i}" for i in range(n)), "", "A Short One", None)
    rows = chunking.chunk_passages(d, 10, 5).orderBy("passage_id", "token_start").collect()
    first = [r for r in rows if r["passage_id"] == 1]
    assert [r["token_start"] for r in first] == [0, 5, 10, 15] and first[-1]["token_end"] == n
    assert first[1]["text"].split() == [f"tok{i}" for i in range(5, 15)]
    rest = {r["passage_id"]: (r["chunk_id"], r["text"], r["token_start"], r["token_end"]) for r in rows if r["passage_id"] > 1}
    assert rest == {2: ("2_0", "", 0, 0), 3: ("3_0", "A Short One", 0, 3), 4: ("4_0", "", 0, 0)}
    with pytest.raises(ValueError):
        chunking.chunk_passages(d, 10, 10)
    with pytest.raises(ValueError):
        chunking.chunk_passages(d, 10, 0)


def test_idf_by_hand(spark):
    d = docs(spark, "cat", "dog", "cat")
    index, lens = postings.postings(d), postings.lengths(d)
    got = {r["term"]: r["idf"] for r in postings.idf(postings.document_frequencies(index), postings.corpus_stats(lens)).collect()}
    assert got["cat"] == pytest.approx(math.log(1.5 / 2.5 + 1), abs=1e-9) and got["dog"] > got["cat"]


def test_statistics_count_empty_documents(spark):
    d = docs(spark, "hello hello world", "", None)
    s = postings.corpus_stats(postings.lengths(d)).first()
    assert (s["n_docs"], s["total_tokens"], s["avgdl"]) == (3, 3, 1.0)
    e = postings.corpus_stats(postings.lengths(d.limit(0))).first()
    assert (e["n_docs"], e["avgdl"]) == (0, 0.0)
    assert {(r["term"], r["tf"]) for r in postings.postings(d).collect()} == {("hello", 2), ("world", 1)}


def _bm25(texts, query, k1=1.2, b=0.75):
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    out = {}
    for i, t in enumerate(toks, 1):
        s = 0.0
        for w in query.split():
            df = sum(w in x for x in toks)
            if w in t:
                tf = t.count(w)
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        if s:
            out[i] = s
    return out


def test_bm25_against_the_formula(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(25)]
    d = docs(spark, *texts)
    index, lens = postings.postings(d), postings.lengths(d)
    stats = postings.corpus_stats(lens)
    q = spark.createDataFrame([(1, "w1 w2 w1"), (2, "w5"), (3, "none"), (4, "")], "qid long, text string")
    terms = bm25.query_terms(q)
    got = {(r["qid"], r["doc_id"]): r["score"] for r in bm25.score_batch(index, lens, stats, terms).collect()}
    want = {(i, k): v for i, t in ((1, "w1 w2 w1"), (2, "w5")) for k, v in _bm25(texts, t).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    some = spark.createDataFrame([(2,), (3,)], "doc_id long")
    cut = {(r["qid"], r["doc_id"]): r["score"] for r in bm25.score_batch(index, lens, stats, terms, some).collect()}
    assert cut.keys() == {k for k in want if k[1] in (2, 3)} and all(cut[k] == pytest.approx(want[k], abs=1e-9) for k in cut)
    top = bm25.retrieve(index, lens, stats, terms, 3).where("qid = 1").orderBy("rank").collect()
    best = sorted((k for k in want if k[0] == 1), key=lambda k: (-round(want[k], 9), k[1]))[:3]
    assert [(r["qid"], r["doc_id"]) for r in top] == best


def test_merged_parts(spark):
    d = docs(spark, "a1 b1 a1", "b1", "c1 a1")
    whole = sorted(map(tuple, postings.postings(d).collect()))
    parts = [postings.postings(d.where(F.col("doc_id") % 2 == i)) for i in range(2)]
    assert sorted(map(tuple, postings.merged(parts).collect())) == whole


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, doc_id long, score double, rank int")


def test_rrf(spark):
    a, b = ranked(spark, [(1, 10, 9.0, 1), (1, 11, 8.0, 2)]), ranked(spark, [(1, 10, 0.9, 1), (1, 12, 0.5, 2)])
    rows = fusion.rrf(fusion.legs(a, b)).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [10, 11, 12]
    assert [r["score"] for r in rows] == pytest.approx([2 / 61, 1 / 62, 1 / 62])


def test_minmax_and_alpha(spark):
    a, b = ranked(spark, [(1, 10, 4.0, 1), (1, 11, 4.0, 2)]), ranked(spark, [(1, 11, -0.2, 1), (1, 12, -0.4, 2)])
    m = fusion.minmax(fusion.legs(a, b))
    got = {(r["leg"], r["doc_id"]): r["score"] for r in m.collect()}
    assert got == {(0, 10): 1.0, (0, 11): 1.0, (1, 11): 1.0, (1, 12): 0.0}
    f = [(r["doc_id"], round(r["score"], 6)) for r in fusion.alpha(m, 0.4).orderBy("rank").collect()]
    assert f == [(11, 1.0), (10, 0.4), (12, 0.0)]
    q = spark.createDataFrame([(1, 12, 1)], "qid long, doc_id long, grade int")
    sweep = fusion.alpha_sweep(m, q, [0.0, 0.5, 1.0])
    best = fusion.best_alpha(sweep).first()
    assert best["alpha"] == 0.0


def test_access(spark):
    known = spark.createDataFrame([(40, ["admin", "sales"]), (41, ["admin"]), (42, ["admin", "analyst", "sales"]), (43, ["analyst"])], "doc_id long, roles array<string>")
    pairs = spark.createDataFrame([(42, "analyst"), (40, "analyst"), (77, "analyst"), (77, "admin"), (42, "guest")], "doc_id long, role string")
    got = {(r["doc_id"], r["role"]): r["allowed"] for r in acl.can_access(pairs, known).collect()}
    assert got == {(42, "analyst"): True, (40, "analyst"): False, (77, "analyst"): False, (77, "admin"): True, (42, "guest"): False}
    run = ranked(spark, [(1, 41, 4.0, 1), (1, 42, 3.0, 2), (1, 43, 2.0, 3), (1, 40, 1.0, 4)])
    assert [(r["doc_id"], r["rank"]) for r in acl.filter_ranked(run, known, "sales").orderBy("rank").collect()] == [(42, 1), (40, 2)]
    assert acl.filter_ranked(run, known, None, 2).count() == 2
    assert {r["doc_id"] for r in acl.accessible(known, "analyst").collect()} == {42, 43}
    made = acl.generate(spark.range(2000).withColumnRenamed("id", "doc_id"))
    assert made.where(F.array_contains("roles", "admin")).count() == 2000
    assert 0.3 < acl.accessible(made, "viewer").count() / 2000 < 0.4


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 9, 1), (3, 9, 1)], "qid long, doc_id long, rank int")
    q = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, 1), (1, 4, 1), (2, 9, 0)], "qid long, doc_id long, grade int")
    assert metrics.dcg(run.where("qid = 1"), q).first()["dcg"] == pytest.approx(9.392789, abs=1e-6)
    nd = {r["qid"]: r["ndcg"] for r in metrics.ndcg_by_query(run, q).collect()}
    assert set(nd) == {1, 2} and nd[2] == 0.0
    assert metrics.mean(metrics.ndcg_by_query(run, q), "ndcg", "m").first()["m"] == pytest.approx(nd[1] / 2)
    rec = {r["qid"]: r["recall"] for r in metrics.recall_by_query(run, q, 2).collect()}
    assert rec == {1: 0.5}
    kept = {r["qid"]: r["recall"] for r in metrics.per_query(run, q).collect()}
    assert kept == {1: 0.75, 2: 0.0}
    rr = {r["qid"]: r["rr"] for r in metrics.mrr_by_query(run, q).collect()}
    assert rr == {1: 1.0, 2: 0.0}
    none = metrics.recall_by_query(run.where("qid = 2"), q)
    assert metrics.mean(none, "recall", "m").first()["m"] == 0.0
    assert metrics.bootstrap(metrics.ndcg_by_query(run, q).limit(0), "ndcg").first()["high"] == 0.0
    b = metrics.bootstrap(metrics.ndcg_by_query(run, q), "ndcg", 200).first()
    assert 0 <= b["low"] <= b["high"] <= 1


def test_latency_places(spark):
    s = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 5.0), ("c", None)], "k string, v double")
    got = {r["k"]: r for r in metrics.latency(s, "k", "v").collect()}
    assert (got["a"]["p50"], got["a"]["p95"], got["a"]["p99"]) == (50.0, 95.0, 99.0)
    assert got["b"]["p99"] == 5.0 and "c" not in got
    assert metrics.median(s.where("k = 'a'"), "k", "v").first()["median"] == 49.5


def test_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(120)]
    v = vectors.as_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = v.where("vec_id % 40 = 0")
    flat = dict(rows)
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(flat[a], flat[b], strict=True))
    got = {}
    for r in vectors.exact_knn(q, v, 5, skip_self=True).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["doc_id"]
    for a, found in got.items():
        want = sorted((i for i in flat if i != a), key=lambda i: (round(dist(a, i), 9), i))[:5]
        assert [found[k] for k in range(1, 6)] == want
    model = vectors.fixed_centroids(v, 4)
    assigned = vectors.assign(v, model)
    assert all(r["cell"] == min(range(4), key=lambda c: (round(dist(r["vec_id"], c), 9), c)) for r in assigned.collect())
    book = vectors.fixed_codebook(assigned, 4, 4, 8, 16)
    codes = vectors.encode(assigned, book)
    assert codes.count() == 120 and len(codes.first()["codes"]) == 4
    # With all cells probed, exact distances give the exact neighbours.
    whole = {(r["qid"], r["rank"]): r["doc_id"] for r in vectors.ivf_flat(q, assigned, model, 4, 5).collect()}
    exact = {(r["qid"], r["rank"]): r["doc_id"] for r in vectors.exact_knn(q, v, 5).collect()}
    assert whole == exact
    pq = vectors.ivf_pq(q, codes, model, book, 2, 5).collect()
    assert pq and all(r["score"] == -r["distance"] for r in pq)
    near = vectors.sq8(v, vectors.sq8_ranges(v)).first()
    assert max(abs(a - b) for a, b in zip(near["v"], near["decoded"], strict=True)) < 0.02
