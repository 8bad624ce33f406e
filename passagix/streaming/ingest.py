"""Passages that arrive as a stream, added to a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagix.operators.postings import corpus_stats, lengths, postings


def passages(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", per_trigger).parquet(folder)


def add_to_index(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's postings and lengths, each under the batch's number, so a batch that runs again replaces itself.

    Ids must be new: one that is added twice counts twice. Runs over what is there and ends.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        postings(batch).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        lengths(batch).write.mode("overwrite").parquet(f"{folder}/lengths/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, lengths and the statistics of all batches so far."""
    lens = spark.read.parquet(f"{folder}/lengths").select("doc_id", F.col("dl").cast("long").alias("dl"))
    return spark.read.parquet(f"{folder}/postings").select("term", "doc_id", "tf"), lens, corpus_stats(lens)
