"""Stored indexes: built, loaded, checked, and made anew from what they came from. A folder holds the tables that Search.load reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagix.operators import acl, postings, vectors
from passagix.sources import encoding, store


def lexical(docs: DataFrame, folder: str, meta: dict | None = None) -> dict:
    """Writes postings (sorted by term, so that a search skips most of a file), lengths and stats. Texts are split once."""
    spark = docs.sparkSession
    store.save(postings.built(store.spread(docs)).repartition("term").sortWithinPartitions("term", "doc_id"), f"{folder}/postings", meta)
    store.save(postings.lengths_of(spark.read.parquet(f"{folder}/postings"), docs), f"{folder}/lengths", meta)
    return store.save(postings.corpus_stats(spark.read.parquet(f"{folder}/lengths")), f"{folder}/stats", meta)


def access(docs: DataFrame, folder: str) -> dict:
    return store.save(acl.generate(docs), f"{folder}/access")


@dataclass
class VectorIndex:
    codes: DataFrame
    model: DataFrame
    codebook: DataFrame
    nprobe: int

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
        return vectors.ivf_pq(queries, self.codes, self.model, self.codebook, nprobe or self.nprobe, k)


def vector_index(table: DataFrame, folder: str, nlist: int = 16, m: int = 32, codes: int = 16, nprobe: int = 16, sample: int = 100_000, seed: int = 42) -> VectorIndex:
    """Trains cells and m codebooks on a hashed sample, assigns and encodes all vectors (vec_id, embedding), and writes codes by cell, model and codebook; nprobe is in the manifest of the codes."""
    spark = table.sparkSession
    v = vectors.as_vectors(table)
    dim = v.select(F.size("v").alias("d")).first()["d"]
    if dim % m:
        raise ValueError(f"{m} sub-spaces do not divide {dim} dimensions")
    store.save(vectors.train_centroids(v, nlist, sample, seed), f"{folder}/model")
    model = spark.read.parquet(f"{folder}/model")
    assigned = vectors.assign(v, model)
    store.save(vectors.train_codebook(assigned, m, codes, dim, sample, seed), f"{folder}/codebook")
    coded = vectors.encode(assigned, spark.read.parquet(f"{folder}/codebook"))
    store.save(coded, f"{folder}/codes", {"nlist": nlist, "m": m, "codes": codes, "nprobe": nprobe, "dim": dim}, ["cell"])
    return load_vector_index(spark, folder, check=False)


def load_vector_index(spark: SparkSession, folder: str, check: bool = True) -> VectorIndex:
    """The three tables and the number of probes that they were stored with. Damaged raises."""
    codes, model, codebook = (store.load(spark, f"{folder}/{name}", check) for name in ("codes", "model", "codebook"))
    return VectorIndex(codes, model, codebook, int(store.manifest(spark, f"{folder}/codes")["meta"]["nprobe"]))


def rebuild_vector_index(spark: SparkSession, embeddings: str, folder: str, **settings) -> VectorIndex:
    """The index made anew, in its place, from stored vectors, which must agree with their manifest. Without settings m is 16."""
    return vector_index(store.load(spark, embeddings), folder, **{"m": 16, **settings})


def sound_vector_index(spark: SparkSession, embeddings: str, folder: str, **settings) -> tuple[VectorIndex, bool]:
    """The stored index if it agrees with its manifests, else one made anew; and whether it had to be."""
    if all(store.valid(spark, f"{folder}/{name}") for name in ("codes", "model", "codebook")):
        return load_vector_index(spark, folder, check=False), False
    return rebuild_vector_index(spark, embeddings, folder, **settings), True


def encoded_corpus(docs: DataFrame, model: Callable[[list[str]], np.ndarray], name: str, dim: int, path: str, batch: int = 256) -> dict:
    """Writes a unit vector for each row of docs, with a manifest that names model and dimension. A different number of vectors than of rows raises, and leaves no manifest."""
    spark, wanted = docs.sparkSession, docs.count()
    encoding.encode(docs, model, name, dim, batch=batch).write.mode("overwrite").parquet(path)
    got = spark.read.parquet(path).count()
    if got != wanted:
        raise RuntimeError(f"{got} vectors for {wanted} texts")
    return store.describe(spark, path, {"model": name, "dim": dim, "count": got})
