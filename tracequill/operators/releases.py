"""Content-addressed snapshots and releases of tables, through Spark's file systems."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_hash(df: DataFrame) -> str:
    """SHA-256 of a table's content, whatever its order and partitions: sums of row digests by halves."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    row = df.agg(F.count(F.lit(1)), *parts).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()


def generation_id(hashes: dict[str, str], versions: dict[str, str]) -> str:
    """First 20 hex digits over the canonical JSON of what went in."""
    return hashlib.sha256(json.dumps({"hashes": hashes, "versions": versions}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:20]


def safe_relative(path: str) -> bool:
    parts = path.split("/")
    return bool(path) and not path.startswith("/") and "\\" not in path and ":" not in path and all(p not in ("", ".", "..") for p in parts)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one of ``schema``."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, versions: dict[str, str]) -> str:
    """Write a generation to a staging folder, verify it, rename it, and point ``current`` to it last.

    A generation that exists already is refused; its id is the content's.
    """
    for name in tables:
        if not safe_relative(name):
            raise ValueError(f"unsafe table name: {name}")
    hashes = {name: table_hash(df) for name, df in tables.items()}
    own = generation_id(hashes, versions)
    final, staging = f"{root}/generation={own}", f"{root}/.staging-{own}"
    if exists(spark, final):
        raise FileExistsError(f"generation {own} is published")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{staging}/{name}")
    for name, want in hashes.items():
        if table_hash(spark.read.parquet(f"{staging}/{name}")) != want:
            raise ValueError(f"staged table {name} differs from what was hashed")
    fs, where = _fs(spark, staging)
    if not fs.rename(where, _fs(spark, final)[1]):
        raise OSError(f"could not rename {staging}")
    before = current(spark, root)
    log = [(own, before["generation"] if before else None, datetime.now(timezone.utc).isoformat(), json.dumps(hashes, sort_keys=True))]
    spark.createDataFrame(log, "generation string, supersedes string, published_at string, hashes string").coalesce(1).write.mode("append").json(f"{root}/current")
    return own


def current(spark: SparkSession, root: str) -> dict | None:
    """The newest pointer, or None."""
    if not exists(spark, f"{root}/current"):
        return None
    row = spark.read.schema("generation string, supersedes string, published_at string, hashes string").json(f"{root}/current").orderBy(F.desc("published_at")).first()
    return row.asDict() if row else None


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the current generation, verified against their hashes again."""
    now = current(spark, root)
    if not now:
        raise FileNotFoundError(f"nothing is published below {root}")
    found = {name: spark.read.parquet(f"{root}/generation={now['generation']}/{name}") for name in json.loads(now["hashes"])}
    for name, want in json.loads(now["hashes"]).items():
        if table_hash(found[name]) != want:
            raise ValueError(f"published table {name} has changed")
    return found
