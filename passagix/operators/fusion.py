"""Ranked lists into one. A list is (qid, leg, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def legs(*lists: DataFrame) -> DataFrame:
    """Lists as one table, numbered by leg in the order given."""
    out = None
    for i, x in enumerate(lists):
        part = x.select("qid", F.lit(i).alias("leg"), "doc_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def rrf(lists: DataFrame, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank). Ties keep the order in which documents first appear, by leg and rank."""
    fused = lists.groupBy("qid", "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "seen", "doc_id"))
    out = fused.select("qid", "doc_id", "score", rank.alias("rank"))
    return out.where(F.col("rank") <= top) if top else out


def minmax(lists: DataFrame) -> DataFrame:
    """Scores of each query and leg from 0 to 1; all 1 where they are equal."""
    w = Window.partitionBy("qid", "leg")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return lists.select("qid", "leg", "doc_id", F.when(hi == lo, 1.0).otherwise(F.try_divide(F.col("score") - lo, hi - lo)).alias("score"), "rank")


def alpha(lists: DataFrame, weight: float | str, top: int | None = 100) -> DataFrame:
    """weight of leg 0's normalised score and the rest of leg 1's; a document that a leg lacks has 0 there. Ties to the smaller id.

    weight may name a column of lists; then each of its values gives a fusion of its own.
    """
    own = isinstance(weight, str)
    keys = [weight, "qid"] if own else ["qid"]
    w = F.col(weight) if own else F.lit(float(weight))
    both = lists.groupBy(*keys, "doc_id").agg(F.sum(F.when(F.col("leg") == 0, F.col("score")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("leg") == 1, F.col("score")).otherwise(0.0)).alias("b"))
    scored = both.select(*keys, "doc_id", (w * F.col("a") + (F.lit(1.0) - w) * F.col("b")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "doc_id"))
    out = scored.withColumn("rank", rank)
    return out.where(F.col("rank") <= top) if top else out


def alpha_sweep(lists: DataFrame, qrels: DataFrame, weights: list[float], k: int = 10) -> DataFrame:
    """(alpha, ndcg): mean nDCG at k of the fusion at each weight, in one plan. lists are normalised."""
    from passagix.operators.metrics import ndcg_by_query

    many = lists.withColumn("alpha", F.explode(F.array(*map(F.lit, weights))))
    return ndcg_by_query(alpha(many, "alpha", k), qrels, k, ["alpha"]).groupBy("alpha").agg(F.avg("ndcg").alias("ndcg"))


def best_alpha(sweep: DataFrame) -> DataFrame:
    """The weight of the best value; of equal ones (to nine places) the smallest."""
    return sweep.agg(F.max_by(F.struct("alpha", "ndcg"), F.struct(F.round("ndcg", 9), -F.col("alpha"))).alias("b")).select("b.alpha", "b.ndcg")
