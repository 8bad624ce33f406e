"""Tables on storage: written whole, with a manifest that a later reader can check them against."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Damaged(ValueError):
    """A stored table is not what its manifest says."""


def keep_last(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key, that of the largest version: the effect of writing one after the other."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return rows.withColumn("__turn", F.row_number().over(w)).where("__turn = 1").drop("__turn")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and Spark is local, as in tests, a new one."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        said = Path(tempfile.mkdtemp(prefix="shared-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", said)
    return said.rstrip("/")


def remembered(name: str, inputs: list[str], spark: SparkSession, build: Callable[[], DataFrame], partition: list[str] | None = None) -> DataFrame:
    """The table that build makes of the files in inputs: written to the shared folder once for each application and state of these files, then read."""
    state = []
    for path in inputs:
        fs, at = _fs(spark, path), _path(spark, path)
        size = fs.getContentSummary(at)
        state.append((path, size.getLength(), size.getFileCount(), fs.getFileStatus(at).getModificationTime()))
    key = hashlib.sha256(json.dumps(state).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{key}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        w = build().write.mode("overwrite")
        (w.partitionBy(*partition) if partition else w).parquet(path)
    return spark.read.parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """table in as many tasks as there are cores at least: for heavy work on each row of files that few tasks can read."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    if not _fs(spark, old).rename(_path(spark, old), _path(spark, new)):
        raise OSError(f"{old} could not be renamed to {new}")


def recover(spark: SparkSession, path: str) -> None:
    """Puts a table back that an upsert left aside when it was cut off before the new one took its place."""
    if not _exists(spark, path) and _exists(spark, f"{path}.old"):
        _renamed(spark, f"{path}.old", path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Replaces rows of the same keys and adds the others.

    The new table is written beside the old one, which is renamed, not deleted, before the new one takes its
    place: at any moment one of the two is whole, and the next upsert, or recover, finds it.
    """
    recover(spark, path)
    if not _exists(spark, path):
        rows.write.parquet(path)
        return
    both = spark.read.parquet(path).withColumn("__v", F.lit(0)).unionByName(rows.withColumn("__v", F.lit(1)))
    new = f"{path}.new-{uuid.uuid4().hex[:8]}"
    keep_last(both, keys, "__v").drop("__v").write.parquet(new)
    fs = _fs(spark, path)
    fs.delete(_path(spark, f"{path}.old"), True)
    _renamed(spark, path, f"{path}.old")
    _renamed(spark, new, path)
    fs.delete(_path(spark, f"{path}.old"), True)


def digest(table: DataFrame) -> dict[str, int]:
    """Rows and two sums over row hashes that do not depend on order or files. Same data, same digest."""
    h = F.xxhash64(*sorted(table.columns))
    x = table.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 31))), F.lit(0)).alias("sum")).first()
    return {"rows": x["rows"], "xor": x["xor"], "sum": x["sum"]}


def save(table: DataFrame, path: str, meta: dict | None = None, partition: list[str] | None = None) -> dict:
    """Writes a table and its manifest (digest, columns, meta), which is written last: without one a table is not whole."""
    spark = table.sparkSession
    w = table.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return describe(spark, path, meta)


def describe(spark: SparkSession, path: str, meta: dict | None = None) -> dict:
    """Writes the manifest of a table that stands at path."""
    stored = spark.read.parquet(path)
    manifest = {"version": 1, "columns": sorted(stored.columns), "digest": digest(stored), "meta": meta or {}}
    put_text(spark, f"{path}.manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def manifest(spark: SparkSession, path: str) -> dict | None:
    at = f"{path}.manifest.json"
    return json.loads(_get(spark, at)) if _exists(spark, at) else None


def valid(spark: SparkSession, path: str) -> bool:
    """Whether table and manifest are there and agree. Never raises for what it finds."""
    said = manifest(spark, path)
    if said is None or not _exists(spark, path):
        return False
    try:
        return digest(spark.read.parquet(path)) == said["digest"]
    except Exception:  # noqa: BLE001  unreadable files are a damaged table
        return False


def load(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    if check and not valid(spark, path):
        raise Damaged(f"{path} does not agree with its manifest")
    return spark.read.parquet(path)


def result_name(kind: str, config: dict, now: datetime | None = None) -> str:
    """{time}_{kind}_{first eight digits of the configuration's SHA-256}.json"""
    short = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]
    return f"{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}_{kind}_{short}.json"


def write_result(spark: SparkSession, folder: str, kind: str, config: dict, metrics: dict, now: datetime | None = None) -> str:
    """An experiment's result; a file that is there already is never changed."""
    now = now or datetime.now(UTC)
    path = f"{folder}/{result_name(kind, config, now)}"
    if _exists(spark, path):
        raise FileExistsError(path)
    put_text(spark, path, json.dumps({"schema_version": "1.0", "kind": kind, "created": now.isoformat(), "config": config, "metrics": metrics}, sort_keys=True, indent=1))
    return path


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    out = _fs(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
