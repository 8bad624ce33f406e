"""Experiments: a run, its metrics, its gates, and a result file that is never changed.

Each driver returns what it wrote. Runs are (qid, doc_id, score, rank), judgments (qid, doc_id, grade);
queries are a stated set, (qid, text) or (vec_id, v).
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagix.operators import acl, bm25, fusion, metrics, vectors
from passagix.plans.search import Search
from passagix.sources import store

#: A lexical baseline's nDCG and how far a run may fall behind it; milliseconds that 99 of 100 requests stay below.
BASELINE, SLACK, P99_LIMIT = 0.49, 0.02, 20.0
#: What the roles of a load test are drawn by.
ROLE_WEIGHTS = {"admin": 0.05, "engineer": 0.35, "analyst": 0.25, "sales": 0.20, "viewer": 0.15}
#: What the modes of a load test are drawn by.
MODE_WEIGHTS = {"hybrid": 6, "bm25": 2, "dense": 1}


def qrels_hash(qrels: DataFrame) -> str:
    """SHA-256 of the judgments, in whatever order they are stored: of each query's sorted lines, then of the queries' digests."""
    line = F.concat_ws(" ", "doc_id", "grade")
    by_query = qrels.groupBy("qid").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    return by_query.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "qid", "h"))), "\n"), 256).alias("h")).first()["h"]


def quality(run: DataFrame, qrels: DataFrame) -> dict[str, float]:
    """nDCG at 10, reciprocal rank at 10 and recall at 100."""
    mean = lambda rows, column: rows.agg(F.coalesce(F.avg(column), F.lit(0.0))).first()[0]
    return {
        "ndcg_10": mean(metrics.ndcg_by_query(run, qrels), "ndcg"),
        "mrr_10": mean(metrics.mrr_by_query(run, qrels), "rr"),
        "recall_100": mean(metrics.recall_by_query(run, qrels), "recall"),
    }


def _per_query(run: DataFrame, qrels: DataFrame) -> dict[str, dict[str, float]]:
    return {str(r["qid"]): {"ndcg": r["ndcg"], "recall": r["recall"]} for r in metrics.per_query(run, qrels).collect()}


def timed(make: Callable[[], DataFrame]) -> tuple[list, float]:
    """The rows of a plan and the milliseconds from its making to its last row."""
    began = time.perf_counter()
    rows = make().collect()
    return rows, (time.perf_counter() - began) * 1000


def evaluate_bm25(search: Search, queries: DataFrame, qrels: DataFrame, folder: str, k: int = 100, k1: float = bm25.K1, b: float = bm25.B, baseline: float = BASELINE) -> dict:
    """The lexical run. Gate: its nDCG is not more than SLACK below the baseline."""
    rows, ms = timed(lambda: bm25.retrieve(search.postings, search.lengths, search.stats, bm25.query_terms(queries), k, k1, b))
    run = search.spark.createDataFrame(rows, "qid long, doc_id long, score double, rank int")
    got = quality(run, qrels)
    gate = {"passed": got["ndcg_10"] - baseline >= -SLACK, "delta": got["ndcg_10"] - baseline}
    return _written(search.spark, folder, "bm25", {"k1": k1, "b": b, "top_k": k, "qrels": qrels_hash(qrels)}, {**got, "batch_ms": ms, "gate": gate, "per_query": _per_query(run, qrels)})


def evaluate_dense(search: Search, queries: DataFrame, qrels: DataFrame, folder: str, k: int = 100, nprobe: int = 16, sweep: tuple[int, ...] = (1, 4, 8, 16, 32, 64)) -> dict:
    """The vector run, and recall and milliseconds of the batch at each number of probes."""
    run, _ = _stored_run(search.spark, vectors.ivf_pq(queries, search.codes, search.model, search.codebook, nprobe, k))
    recall = {r["nprobe"]: r["recall"] for r in vectors.nprobe_sweep(queries, search.codes, search.model, search.codebook, qrels, list(sweep), k).collect()}
    ms = {n: timed(lambda n=n: vectors.ivf_pq(queries, search.codes, search.model, search.codebook, n, k))[1] for n in sweep}
    swept = [{"nprobe": n, "recall": recall.get(n), "batch_ms": ms[n]} for n in sweep]
    return _written(search.spark, folder, "dense", {"nprobe": nprobe, "top_k": k, "qrels": qrels_hash(qrels)}, {**quality(run, qrels), "sweep": swept, "per_query": _per_query(run, qrels)})


def evaluate_hybrid(spark: SparkSession, lexical: DataFrame, dense: DataFrame, qrels: DataFrame, folder: str, weights: list[float] | None = None) -> dict:
    """Each leg, their fusion by ranks, and by the best weight. Gate: the fusion by ranks is better than the vectors alone."""
    weights = weights or [i / 10 for i in range(11)]
    legs = fusion.legs(lexical, dense)
    normal = fusion.minmax(legs)
    sweep = fusion.alpha_sweep(normal, qrels, weights)
    rows = [{"alpha": r["alpha"], "ndcg_10": r["ndcg"]} for r in sweep.orderBy("alpha").collect()]
    best = fusion.best_alpha(sweep).first()["alpha"]
    systems = {"bm25": lexical, "dense": dense, "rrf": fusion.rrf(legs), "best_alpha": fusion.alpha(normal, best)}
    table = {name: quality(run, qrels) for name, run in systems.items()}
    gate = {"passed": table["rrf"]["ndcg_10"] > table["dense"]["ndcg_10"]}
    return _written(spark, folder, "hybrid", {"rrf_k": fusion.RRF_K, "weights": weights, "qrels": qrels_hash(qrels)}, {"ablation": table, "sweep": rows, "alpha": best, "gate": gate})


def evaluate_acl(spark: SparkSession, ranked: DataFrame, access: DataFrame, qrels: DataFrame, folder: str, roles: list[str] | None = None, k: int = 100, oversample: int = 2) -> dict:
    """What each role's filter costs in recall. ranked holds oversample times k of each query."""
    rows = acl.recall_drop(ranked.where(F.col("rank") <= k * oversample), access, qrels, roles or list(acl.SHARES), k).collect()
    return _written(spark, folder, "acl", {"top_k": k, "oversample": oversample, "qrels": qrels_hash(qrels)}, {r["role"]: {"recall": r["recall"], "drop": r["drop"]} for r in rows})


def evaluate_latency(search: Search, queries: list[str], folder: str, mode: str = "hybrid", top_k: int = 10, role: str | None = None, embeddings: list[list[float]] | None = None, limit: float = P99_LIMIT) -> dict:
    """Percentiles of each stage over requests made one after the other. Gate: the 99th of whole requests is below the limit."""
    before = len(search.tracer.spans)
    for i, q in enumerate(queries):
        search.search(q, mode, top_k, role, embedding=embeddings[i] if embeddings else None)
    spans = search.spark.createDataFrame([(s.name, s.ms) for s in search.tracer.spans[before:]], "stage string, ms double")
    stats = {r["stage"]: {c: r[c] for c in ("n", "mean", "p50", "p95", "p99")} for r in metrics.latency(spans, "stage", "ms").collect()}
    p99 = stats.get("full_query", {}).get("p99")
    return _written(search.spark, folder, "latency", {"mode": mode, "top_k": top_k, "role": role, "queries": len(queries)}, {"stages": stats, "gate": {"passed": p99 is not None and p99 < limit, "p99": p99}})


def evaluate_quantisation(table: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str, nlist: int = 16, nprobe: int = 16, k: int = 100, variants: tuple[str, ...] = ("m16", "m32", "sq8")) -> dict:
    """Bytes of codes for each vector, quality and batch milliseconds of product codes of several lengths and of eight-bit scalars, on the same cells."""
    from passagix.plans.build import vector_index

    spark, out = table.sparkSession, {}
    v = vectors.as_vectors(table)
    for name in variants:
        if name == "sq8":
            model = vectors.train_centroids(v, nlist)
            search = lambda model=model: vectors.ivf_sq8(queries, vectors.assign(v, model), model, vectors.sq8_ranges(v), nprobe, k)
            size = v.select(F.size("v")).first()[0]
        else:
            size = int(name[1:])
            index = vector_index(table, f"{folder}/{name}", nlist, size, nprobe=nprobe)
            search = lambda index=index: index.search(queries, k)
        run, ms = _stored_run(spark, search())
        out[name] = {"bytes_a_vector": size, "batch_ms": ms, **quality(run, qrels)}
    return _written(spark, folder, "quantisation", {"nlist": nlist, "nprobe": nprobe, "top_k": k}, out)


def load_test(search: Search, pool: list[str], requests: int = 100, threads: int = 4, roles: bool = False, seed: int = 42, embeddings: dict[str, list[float]] | None = None) -> dict:
    """Requests from several threads of one session, of modes and roles drawn by weight; errors are counted by kind and do not end the test."""
    rng = random.Random(seed)
    able = {m: w for m, w in MODE_WEIGHTS.items() if search.ready()[m]}
    if not able:
        raise RuntimeError("no mode is ready")
    drawn = [(rng.choice(pool), rng.choices(list(able), list(able.values()))[0], rng.choices(list(ROLE_WEIGHTS), list(ROLE_WEIGHTS.values()))[0] if roles else None) for _ in range(requests)]

    def one(request: tuple[str, str, str | None]) -> tuple[str, float, str | None]:
        query, mode, role = request
        began, error = time.perf_counter(), None
        try:
            search.search(query, mode, 10, role, embedding=(embeddings or {}).get(query))
        except Exception as e:  # noqa: BLE001  counted
            error = type(e).__name__
        return mode, (time.perf_counter() - began) * 1000, error

    began = time.perf_counter()
    with ThreadPoolExecutor(threads) as workers:
        done = list(workers.map(one, drawn))
    took = time.perf_counter() - began
    errors: dict[str, int] = {}
    for _, _, e in done:
        if e:
            errors[e] = errors.get(e, 0) + 1
    good = search.spark.createDataFrame([(m, ms) for m, ms, e in done if not e], "mode string, ms double")
    stats = {r["mode"]: {c: r[c] for c in ("n", "mean", "p50", "p95", "p99")} for r in metrics.latency(good, "mode", "ms").collect()}
    return {"requests": requests, "errors": errors, "requests_a_second": requests / took, "modes": stats}


def _stored_run(spark: SparkSession, plan: DataFrame) -> tuple[DataFrame, float]:
    """A run of a stated set of queries, k rows each, made once; and its milliseconds."""
    rows, ms = timed(lambda: plan.select("qid", "doc_id", "score", "rank"))
    return spark.createDataFrame(rows, "qid long, doc_id long, score double, rank int"), ms


def _written(spark: SparkSession, folder: str, kind: str, config: dict, found: dict) -> dict:
    return {"path": store.write_result(spark, folder, kind, config, found), "config": config, "metrics": found}
