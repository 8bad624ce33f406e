"""What the corpus operators share: tables, the shared folder, and shipping of the code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagix.sources.store import shared_dir

ROOT = Path(__file__).resolve().parents[2]
PACKAGE = Path(__file__).resolve().parents[1].name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: With this set, a query's shuffle files go when it has ended, rather than when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as written to a new table in the shared folder and read again: it cuts the lineage, and lost executors don't lose it.

    The shuffle files of the write go as soon as it has ended, as nothing reads them again. options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more: what came of them must be settled itself, or be at the driver."""
    for t in tables:
        spark, path = t.sparkSession, t._settled_at
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, for sessions that were started without it in PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_shipped_package", False):
        return
    fd, name = tempfile.mkstemp(prefix=f"{PACKAGE}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((ROOT / PACKAGE).rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(name)
    sc._shipped_package = True


def train_part(doc_id: str = "doc_id") -> Column:
    """True where labels may be learned from; false for the held-out quarter. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 != 2


def own_name(df: DataFrame, wish: str) -> str:
    """A column name like wish that df does not have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
