"""Session helpers: shared scratch space and table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_SCOPES: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores, where it is read in fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that
    is unset, as in local tests, a temporary folder of this machine is used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tracequill-"))
        spark.sparkContext.setCheckpointDir(_LOCAL[0])
    return _LOCAL[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when its :func:`scope` or else the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    for opened in _SCOPES:
        opened.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Drops at its end what was written inside, for results that are stored elsewhere by then."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        for path in own:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a shared path; a session that has ended already keeps it."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at interpreter exit
        pass


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def identified(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a column that tells all its rows apart, whatever they hold, in every run.

    Rows of stored files have their place in the file; others are written first.
    """
    if "_metadata" not in df.columns:
        try:
            found = df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias(name))
            return found if found.schema else df
        except AnalysisException:
            pass
    numbered = df.select("*", F.struct(F.lit("").alias("f"), F.monotonically_increasing_id().alias("i")).alias(name))
    return written(df.sparkSession, numbered, "numbered")
