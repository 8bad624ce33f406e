"""Readers and writers with fixed schemas: nothing is inferred, and every key is a long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PASSAGE = "pid string, text string"
ACL = "pid string, roles array<string>"


def read_corpus(spark: SparkSession, path: str, limit: int | None = None, partition_bytes: int | None = None) -> DataFrame:
    """(doc_id, text) from JSON lines {pid, text}; pid may be a number or a text. limit: the rows of the smallest ids.

    Files are split by bytes among tasks; partition_bytes sets the size of a split for this table alone, as it is
    read by a session of its own with the same catalog and context.
    """
    if partition_bytes:
        spark = spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", partition_bytes)
    rows = spark.read.schema(PASSAGE).json(path).select(F.col("pid").cast("long").alias("doc_id"), "text")
    return rows.orderBy("doc_id").limit(limit) if limit else rows


def write_corpus(docs: DataFrame, path: str, numbers: bool = False, limit: int | None = None, doc_id: str = "doc_id") -> None:
    """JSON lines with pid as a text, or as a number."""
    rows = docs.orderBy(doc_id).limit(limit) if limit else docs
    rows.select(F.col(doc_id).cast("long" if numbers else "string").alias("pid"), "text").write.mode("overwrite").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) from one JSON object of texts."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("qid", "text")).select(F.col("qid").cast("long").alias("qid"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, grade) from one JSON object of objects of grades."""
    whole = spark.read.text(path, wholetext=True)
    by_query = whole.select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("qid", "g"))
    return by_query.select(F.col("qid").cast("long").alias("qid"), F.explode("g").alias("doc_id", "grade")).select("qid", F.col("doc_id").cast("long").alias("doc_id"), "grade")


def combined(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables; where keys clash the second wins."""
    return first.join(second.select(*keys).distinct(), keys, "left_anti").unionByName(second)


def read_acl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, roles) from a JSON list, or JSON lines, of {pid, roles}."""
    return spark.read.schema(ACL).json(path, multiLine=True).select(F.col("pid").cast("long").alias("doc_id"), "roles")


def write_acl(acl: DataFrame, path: str) -> None:
    acl.select(F.col("doc_id").cast("string").alias("pid"), F.array_sort("roles").alias("roles")).write.mode("overwrite").json(path)


def lookup(store: DataFrame, keys: DataFrame, key: str, keep_missing: bool = False) -> DataFrame:
    """The stored rows of the keys; missing ones are left out, or kept with nulls."""
    return keys.select(key).join(store, key, "left" if keep_missing else "inner")


def query_pool(spark: SparkSession, path: str | None, fallback: list[str]) -> list[str]:
    """Query texts from a file of queries, or the fallback if there is none."""
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return [r["text"] for r in read_queries(spark, path).orderBy("qid").collect()] or fallback
    return fallback


def prometheus(log: DataFrame, ready: bool = True) -> str:
    """The four series of a query log (ok boolean, ms double) as metric lines. The mean is over successes; ready is what Search.ready says."""
    x = log.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("bad"), F.coalesce(F.avg(F.when(F.col("ok"), F.col("ms"))), F.lit(0.0)).alias("ms")).first()
    return f"search_requests_total {x['n']}\nsearch_errors_total {x['bad']}\nsearch_latency_mean_ms {x['ms']:.3f}\nsearch_ready {int(ready)}\n"
