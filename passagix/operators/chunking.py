"""Passages into overlapping windows of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagix.functions.text import chunk_tokens


def chunk_passages(passages: DataFrame, window: int = 256, stride: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk_id, passage_id, text, token_start, token_end). A passage of up to window tokens is one chunk, with its own text.

    Longer ones give windows of lower-case tokens that begin every stride tokens, up to the first that
    reaches the end. One task has a passage; nothing is shuffled. Null texts are one empty chunk.
    """
    if not 1 <= stride < window:
        raise ValueError("the stride is at least 1 and less than the window")
    rows = _split(passages, doc_id, text)
    return _cut(rows.withColumn("k", F.explode(F.sequence(F.lit(0), _count(window, stride) - 1))), window, stride)


def chunks_of(passages: DataFrame, wanted: DataFrame, window: int = 256, stride: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """chunk_passages of the chunk ids in wanted (chunk_id), as often as they stand there; unknown ones are left out.

    Passages meet the ids before they are cut, so what moves is each text once, not each of its overlapping windows.
    """
    place = "^(.*)_([0-9]+)$"
    ids = wanted.select("chunk_id", F.regexp_extract("chunk_id", place, 1).alias("__p"), F.regexp_extract("chunk_id", place, 2).try_cast("int").alias("k")).where("k is not null and concat_ws('_', __p, k) = chunk_id")
    asked = ids.groupBy("__p").agg(F.collect_list("k").alias("__ks"))
    # Those asked for may stand in few files.
    known = passages.join(asked, F.col(doc_id).cast("string") == F.col("__p")).repartition("__p")
    rows = _split(known, doc_id, text, "__ks")
    return _cut(rows.withColumn("k", F.explode(F.filter("__ks", lambda k: k < _count(window, stride)))), window, stride)


def _split(passages: DataFrame, doc_id: str, text: str, *others: str) -> DataFrame:
    return passages.select(F.col(doc_id).alias("passage_id"), F.coalesce(F.col(text), F.lit("")).alias("whole"), chunk_tokens(text).alias("t"), *others)


def _count(window: int, stride: int) -> Column:
    n = F.size("t")
    return F.when(n <= window, 1).otherwise(F.ceil((n - window) / F.lit(stride)) + 1).cast("int")


def _cut(rows: DataFrame, window: int, stride: int) -> DataFrame:
    """The chunks k of split passages."""
    n = F.size("t")
    rows = rows.withColumn("token_start", F.col("k") * stride)
    part = F.array_join(F.slice("t", F.col("token_start") + 1, F.lit(window)), " ")
    return rows.select(
        F.concat_ws("_", "passage_id", "k").alias("chunk_id"),
        "passage_id",
        F.when(n <= window, F.col("whole")).otherwise(part).alias("text"),
        "token_start",
        F.least(F.col("token_start") + window, n).alias("token_end"),
    )


def chunk_map(chunks: DataFrame) -> DataFrame:
    """Which passage each chunk is of: a table, as it grows with the corpus."""
    return chunks.select("chunk_id", "passage_id")
