"""Search over stored tables, for one request or a batch of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagix.operators import acl, bm25, fusion, vectors
from passagix.plans.tracing import Tracer
from passagix.sources import store

MODES = ("bm25", "dense", "hybrid", "alpha")


def check(query: str, mode: str = "hybrid", top_k: int = 10, nprobe: int = 16) -> None:
    if not 1 <= len(query) <= 2048:
        raise ValueError("a query has 1 to 2048 characters")
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if not 1 <= top_k <= 1000 or not 1 <= nprobe <= 512:
        raise ValueError("top_k is from 1 to 1000, nprobe from 1 to 512")


@dataclass
class Search:
    """Tables that are there serve the modes that need them; the others raise. Without access lists a role sees nothing."""

    spark: SparkSession
    postings: DataFrame | None = None
    lengths: DataFrame | None = None
    stats: DataFrame | None = None
    codes: DataFrame | None = None
    model: DataFrame | None = None
    codebook: DataFrame | None = None
    access: DataFrame | None = None
    encoder: Callable[[list[str]], np.ndarray] | None = None
    weight: float = 0.4
    tracer: Tracer = field(default_factory=Tracer)
    missing: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, encoder: Callable[[list[str]], np.ndarray] | None = None, check: bool = True) -> Search:
        """What stands in a folder (see build): tables that are missing or damaged leave their modes out, with the reason in `missing`."""
        names = ("postings", "lengths", "stats", "codes", "model", "codebook", "access")
        tables, missing = {}, {}
        for name in names:
            try:
                tables[name] = store.load(spark, f"{folder}/{name}", check)
            except Exception as e:  # noqa: BLE001  a service starts with what it has
                missing[name] = str(e).splitlines()[0]
        return cls(spark, **tables, encoder=encoder, missing=missing)

    def ready(self) -> dict[str, bool]:
        lexical = None not in (self.postings, self.lengths, self.stats)
        dense = None not in (self.codes, self.model, self.codebook)
        return {"bm25": lexical, "dense": dense, "hybrid": lexical and dense, "alpha": lexical and dense, "acl": self.access is not None}

    def _lexical(self, queries: DataFrame, k: int) -> DataFrame:
        return bm25.retrieve(self.postings, self.lengths, self.stats, bm25.query_terms(queries), k)

    def _dense(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        return vectors.ivf_pq(queries.select(F.col("qid").alias("vec_id"), vectors.doubles("embedding").alias("v")), self.codes, self.model, self.codebook, nprobe, k)

    def run(self, queries: DataFrame, mode: str = "hybrid", top_k: int = 10, role: str | None = None, nprobe: int = 16) -> DataFrame:
        """(qid, doc_id, score, rank) for all queries (qid, text, embedding) in one plan.

        Twice top_k documents are found for the filter, twice that by each leg of a fusion. dense has the
        similarity, minus the distance, as its score.
        """
        check("x", mode, top_k, nprobe)
        if not self.ready()[mode]:
            raise RuntimeError(f"tables for {mode} are missing")
        wide = 2 * top_k
        if mode == "bm25":
            found = self._lexical(queries, wide)
        elif mode == "dense":
            found = self._dense(queries, wide, nprobe).drop("distance")
        else:
            legs = fusion.legs(self._lexical(queries, 2 * wide), self._dense(queries, 2 * wide, nprobe))
            found = fusion.rrf(legs, top=wide) if mode == "hybrid" else fusion.alpha(fusion.minmax(legs), self.weight, wide)
        if role is None:
            return found.where(F.col("rank") <= top_k)
        access = self.access if self.access is not None else self.spark.createDataFrame([], "doc_id long, roles array<string>")
        return acl.filter_ranked(found, access, role, top_k)

    def search(self, query: str, mode: str = "hybrid", top_k: int = 10, role: str | None = None, nprobe: int = 16, embedding: list[float] | None = None) -> list[dict]:
        """One request, stage by stage, each a span: dense_encode, bm25_retrieval, vector_search, fusion, acl_filter and full_query. What a stage finds, four times top_k at most, is at the driver between them."""
        check(query, mode, top_k, nprobe)
        if not self.ready()[mode]:
            raise RuntimeError(f"tables for {mode} are missing")
        wide = 2 * top_k if mode in ("bm25", "dense") else 4 * top_k
        found: list[DataFrame] = []
        with self.tracer.span("full_query", query, top_k=top_k, mode=mode):
            if embedding is None and mode != "bm25":
                if self.encoder is None:
                    raise RuntimeError("a query vector or an encoder is needed")
                with self.tracer.span("dense_encode", query):
                    embedding = [float(x) for x in np.asarray(self.encoder([query]))[0]]
            asked = self.spark.createDataFrame([(0, query, embedding)], "qid long, text string, embedding array<double>")
            if mode != "dense":
                found.append(self._stage("bm25_retrieval", query, self._lexical(asked, wide)))
            if mode != "bm25":
                found.append(self._stage("vector_search", query, self._dense(asked, wide, nprobe).drop("distance")))
            ranked = found[0]
            if len(found) > 1:
                legs = fusion.legs(*found)
                ranked = self._stage("fusion", query, fusion.rrf(legs, top=2 * top_k) if mode == "hybrid" else fusion.alpha(fusion.minmax(legs), self.weight, 2 * top_k))
            if role is not None:
                access = self.access if self.access is not None else self.spark.createDataFrame([], "doc_id long, roles array<string>")
                ranked = self._stage("acl_filter", query, acl.filter_ranked(ranked, access, role, top_k))
            rows = ranked.where(F.col("rank") <= top_k).orderBy("rank").collect()
        return [{"doc_id": r["doc_id"], "score": r["score"], "rank": r["rank"]} for r in rows]

    def _stage(self, name: str, query: str, rows: DataFrame) -> DataFrame:
        with self.tracer.span(name, query) as s:
            got = rows.select("qid", "doc_id", "score", "rank").collect()
            s.attributes["results"] = len(got)
        return self.spark.createDataFrame(got, "qid long, doc_id long, score double, rank int")

    def latencies(self) -> DataFrame:
        """Percentiles by stage of what has run."""
        from passagix.operators.metrics import latency

        return latency(self.tracer.table(self.spark), "stage", "ms")
