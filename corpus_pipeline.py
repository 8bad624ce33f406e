"""The corpus pipeline: toxic documents go, repeated lines and near-duplicates go, sources are mixed, and the rest is packed.

Every stage keeps all columns of documents, extra ones too, but the last, and takes nulls in any of them, texts
of any length, repeated rows and empty tables. What each does with them is said at its function and, in full, at
the operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagix.llm import lines, mixing, packing, simhash, toxicity
from passagix.llm.common import discarded, own_name, settled, table
from passagix.llm.tokens import public


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model learns from the labelled documents among them.

    Null and empty texts stay, each with its repeats; labels without an id or a value teach nothing, and
    without labels of both kinds no document goes.
    """
    labelled = toxicity.labelled_documents(docs, table(spark, sf_dir, "labels"))
    model = toxicity.fit(labelled)
    discarded(labelled)
    return toxicity.reject_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; n_chars follows the text. Documents left empty stay.

    Null texts stay null, with null n_chars; rows of one id and text lose the same lines; null ids come first.
    """
    kept = lines.dedup_lines(docs)
    return kept.selectExpr(*(f"cast(char_length(text) as {t}) as n_chars" if c == "n_chars" else f"`{c}`" for c, t in docs.dtypes))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, and of rows that repeat with it the first.

    Null, empty and blank texts are one group. An id counts as smaller than none.
    """
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, shard after shard, and each shard in the order of its shuffle.

    Documents without a word are taken once; a null source is a source; rows that repeat are documents of their own.
    """
    return mixing.mix(docs).orderBy(own_name(docs, "shard"), own_name(docs, "place")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; a document that the mix took twice is packed twice, a null text as an empty one."""
    return packing.pack(docs, public("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        after = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discarded(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
