"""Nearest neighbours: cross-polytope hashing, and what it leaves out, exactly.

Each table turns unit vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and puts a vector in the cell of its nearest signed axis. A query looks in the cells of its
several nearest axes in each table; all vectors found there are scored exactly, in double precision.

The worst of the best scores so found is a bound: no neighbour scores less. With it each query passes all
cells of the first table, which hold every vector once, and leaves out those whose ball (centre, radius)
cannot reach it. So nothing is lost, whatever the vectors' lengths, clusters or number; where balls do not
part the vectors, as among random ones, every pair is scored.

Only distinct vectors take part. Of the ids of one vector only the smallest k + 1 can be among a query's
nearest, so no more are carried, whatever the number of copies. A cell of many vectors is cut into blocks,
each a task's share, and each block returns its best k + 1 for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagix.llm.common import settled, ship, table

K = 20
#: Tables, probes in each, and rows of a block.
TABLES, PROBES, BLOCK = 12, 8, 8192
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, table_no: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The nearest signed axes of each row after the table's rotation, nearest first: rows x probes."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    y[:, : x.shape[1]] = x / np.where(norm > 0, norm, 1)
    rng = np.random.default_rng([seed, table_no, d])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    both = np.concatenate([y, -y], 1)
    if probes == 1:
        return both.argmax(1)[:, None]
    probes = min(probes, 2 * d)
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, 1), axis=1), 1)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1)


def distinct_vectors(vectors: DataFrame, vec_id: str, embedding: str, k: int) -> DataFrame:
    """(key, embedding, ids): distinct vectors that take part, with their smallest k + 1 ids, ascending. key: 128 bits of the components' digest."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(fine & F.exists("v", lambda x: x != 0)).select("id", F.transform("v", lambda x: x + 0.0).alias("v"))
    v = v.withColumn("key", F.substring(F.md5(F.to_json(F.struct("v"))), 1, 32))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = v.withColumn("r", rank).where(F.col("r") <= k + 1)
    return few.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v")).select("key", "v", "ids")


def cells(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """(key, v, ids) -> with cell, one row for each probe of each table; dimension and table are part of the cell's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) for x in b.column(1)])
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                x = _matrix(part.column(1))
                for t in range(tables):
                    at = axes(x, t, probes)
                    rows = np.repeat(np.arange(len(x)), at.shape[1])
                    cell = (int(d) << 32) | (t << 24) | at.ravel().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in part.columns), pa.array(cell)], names=["key", "v", "ids", "cell"])

    return vectors.mapInArrow(run, "key string, v array<double>, ids array<long>, cell long")


def _best(queries: pd.DataFrame, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query the members of the k best scores, with all members of the last score."""
    none = pd.DataFrame({"query": pd.Series(dtype=str), "key": pd.Series(dtype=str), "score": pd.Series(dtype=float)})
    if not len(queries) or not len(members):
        return none
    q, x = np.stack(queries["v"].to_list()), np.stack(members["v"].to_list())
    out, names = [], members["key"].to_numpy()
    for lo in range(0, len(q), 512):
        s = q[lo : lo + 512] @ x.T
        if s.shape[1] > k:
            edge = np.partition(s, -k, axis=1)[:, -k]
            rows, cols = np.nonzero(s >= edge[:, None] - 1e-12)
        else:
            rows, cols = (i.ravel() for i in np.indices(s.shape))
        out.append(pd.DataFrame({"query": queries["key"].to_numpy()[lo + rows], "key": names[cols], "score": s[rows, cols]}))
    return pd.concat(out, ignore_index=True)


def _above(queries: pd.DataFrame, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query the members that score its bound at least, but of each cell no more than the k best with all of the last score.

    What rounding may have moved below an edge is kept: the scores that decide are made later, in one order of sums.
    """
    out = [pd.DataFrame({"query": pd.Series(dtype=str), "key": pd.Series(dtype=str)})]
    if not len(queries) or not len(members):
        return out[0]
    q, bound, names = np.stack(queries["v"].to_list()), queries["bound"].to_numpy(np.float64), queries["key"].to_numpy()
    length = np.linalg.norm(q, axis=1)
    for _, part in members.groupby(["cell", "block"]):
        x, keys = np.stack(part["v"].to_list()), part["key"].to_numpy()
        centre = x.mean(0)
        slack = 1e-12 * length * np.linalg.norm(x, axis=1).max()
        reach = q @ centre + length * np.linalg.norm(x - centre, axis=1).max()
        alive = np.nonzero(reach >= bound - 2 * slack)[0]
        for lo in range(0, len(alive), 512):
            at = alive[lo : lo + 512]
            s = q[at] @ x.T
            edge = np.maximum(bound[at], np.partition(s, -k, axis=1)[:, -k]) if s.shape[1] > k else bound[at]
            rows, cols = np.nonzero(s >= (edge - slack[at])[:, None])
            out.append(pd.DataFrame({"query": names[at[rows]], "key": keys[cols]}))
    return pd.concat(out, ignore_index=True)


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = K, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """For each row whose id is divisible by `every`, its k nearest other rows: query_id, rank, vec_id, score.

    Largest inner product first, ties to the smaller id. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do null ids; vectors of different length do not meet. A row that
    repeats with its id is another candidate of the same id. If there are fewer than k others, all are
    returned. tables and probes decide how tight the bounds are, not what is returned. Empty tables give no
    rows; extra columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    distinct = settled(distinct_vectors(vectors, vec_id, embedding, k), "vectors")
    asked = vectors.select(F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("query_id") % every == 0)
    asked = asked.where("v is not null").select("query_id", F.substring(F.md5(F.to_json(F.struct(F.transform("v", lambda x: x + 0.0).alias("v")))), 1, 32).alias("key"))
    queries = distinct.join(asked.select("key").distinct(), "key", "left_semi")
    hashed = settled(cells(distinct, tables, 1).select("key", "v", "cell"), "cells")
    sizes = hashed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = hashed.join(F.broadcast(sizes), "cell").select("key", "v", "cell", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int").alias("block"))
    probing = cells(queries, tables, probes).select("key", "v", "cell").join(F.broadcast(sizes), "cell").select("key", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return _best(q, x, k + 1)

    found = probing.groupBy("cell", "block").cogroup(members.groupBy("cell", "block")).applyInPandas(run, "query string, key string, score double")
    # One score for a pair: products of another block size may differ in the last bit.
    pairs = found.groupBy("query", "key").agg(F.max("score").alias("score"))
    few = pairs.withColumn("r", F.rank().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12))))).where(F.col("r") <= k + 1).drop("r")
    # With k + 1 vectors found, the query's own among them, no neighbour scores less than the last.
    bounds = few.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score") - 2e-12).alias("bound"))
    asking = queries.join(bounds, F.col("key") == F.col("query"), "left").select("key", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), F.size("v").alias("width"))
    # Cells of the first table, put together to units of about a block.
    first = sizes.where(F.shiftright("cell", 24) % 256 == 0).select("cell", (F.col("n") / F.col("blocks")).alias("share"), F.shiftright("cell", 32).cast("int").alias("width"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    so_far = F.sum("share").over(Window.partitionBy("width").orderBy("cell", "block"))
    units = settled(first.select("cell", "block", "width", F.floor((so_far - F.col("share")) / BLOCK).alias("unit")), "units")
    held = members.join(F.broadcast(units), ["cell", "block"]).select("key", "v", "cell", "block", "width", "unit")
    asking = asking.join(F.broadcast(units.groupBy("width", F.col("unit").alias("part")).count()), "width").select("key", "v", "bound", "width", F.col("part").alias("unit"))

    def rest_of(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return _above(q, x, k + 1)

    few = settled(asking.groupBy("width", "unit").cogroup(held.groupBy("width", "unit")).applyInPandas(rest_of, "query string, key string"), "found")
    exact = F.aggregate(F.zip_with("qv", "xv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = few.join(distinct.select(F.col("key").alias("query"), F.col("v").alias("qv")), "query").join(distinct.select("key", F.col("v").alias("xv"), "ids"), "key").select("query", "ids", exact.alias("score"))
    listed = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    best = listed.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    own = asked.join(lists.withColumnRenamed("query", "key"), "key")
    rest = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(rest).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
