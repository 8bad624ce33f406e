"""Which roles may see which passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The share of passages that each role sees.
SHARES = {"admin": 1.0, "engineer": 0.80, "analyst": 0.65, "sales": 0.50, "viewer": 0.35}


def generate(docs: DataFrame, shares: dict[str, float] = SHARES, seed: int = 42, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, roles): each role sees its share of passages, chosen by a hash of passage and role, so the same on any cluster."""
    def sees(role: str, share: float):
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", doc_id, F.lit(role), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        return F.when(draw < share, F.lit(role)) if share < 1 else F.lit(role)

    return docs.select(F.col(doc_id).alias("doc_id"), F.array_sort(F.array_compact(F.array(*(sees(*x) for x in shares.items())))).alias("roles"))


def can_access(pairs: DataFrame, acl: DataFrame) -> DataFrame:
    """pairs (doc_id, role) with allowed. Unknown passages are the admin's alone; unknown roles see nothing."""
    known = pairs.join(acl, "doc_id", "left")
    return known.select(*pairs.columns, F.array_contains(F.coalesce("roles", F.array(F.lit("admin"))), F.col("role")).alias("allowed"))


def accessible(acl: DataFrame, role: str) -> DataFrame:
    return acl.where(F.array_contains("roles", role)).select("doc_id")


def filter_ranked(ranked: DataFrame, acl: DataFrame, role: str | None = None, k: int | None = None) -> DataFrame:
    """A ranked list (qid, doc_id, score, rank) as a role sees it, in its order, cut to k. role None: the column role of ranked, if it has one, else no filter."""
    keys = ["qid"]
    if role is not None:
        ranked = ranked.withColumn("__role", F.lit(role))
    elif "role" in ranked.columns:
        ranked, keys = ranked.withColumn("__role", F.col("role")), ["role", "qid"]
    else:
        return ranked.where(F.col("rank") <= k) if k else ranked
    seen = ranked.join(acl, "doc_id", "left").where(F.array_contains(F.coalesce("roles", F.array(F.lit("admin"))), F.col("__role"))).drop("roles", "__role")
    out = seen.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "doc_id")))
    return out.where(F.col("rank") <= k) if k else out


def recall_drop(ranked: DataFrame, acl: DataFrame, qrels: DataFrame, roles: list[str], k: int = 100) -> DataFrame:
    """(role, recall, drop): recall at k of what each role sees against that of the unfiltered list, to four places, halves to even.

    ranked holds more than k, so that a filter still leaves k.
    """
    from passagix.operators.metrics import recall_by_query

    every = ranked.withColumn("role", F.explode(F.array(*map(F.lit, roles))))
    seen = filter_ranked(every, acl, None, k).unionByName(ranked.where(F.col("rank") <= k).withColumn("role", F.lit("unrestricted")))
    means = recall_by_query(seen, qrels, k, ["role"], [*roles, "unrestricted"]).groupBy("role").agg(F.avg("recall").alias("recall"))
    # A row for each role, so one small window.
    whole = F.max(F.when(F.col("role") == "unrestricted", F.col("recall"))).over(Window.partitionBy())
    return means.select("role", F.bround("recall", 4).alias("recall"), F.bround(whole - F.col("recall"), 4).alias("drop"))
