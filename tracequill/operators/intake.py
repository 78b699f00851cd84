"""From an inbox of files to archived cases: which files may come in, under which number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequill.session import written
from tracequill.sources.cases import CaseSource

FORMATS = ("srt", "vtt", "txt", "md")
RESERVED = ("readme.md", ".gitkeep")
PREFIX = "case"


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """name and content of the files in a folder (not below it)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def checked(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds slug, format, sha256 and ``status``: reserved, unsafe, unsupported, archived (a case has the same bytes), repeated (an earlier name
    of the inbox has), taken (a case or an earlier file has the slug) or accepted; the first that holds.

    ``existing``: case_id, sha256. Equal bytes and equal slugs are compared in name order.
    """
    low = F.lower("name")
    rows = files.withColumn("slug", F.regexp_replace(low, r"\.[^.]*$", "")).withColumn("format", F.regexp_extract(low, r"\.([^.]+)$", 1)).withColumn("sha256", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    own = F.when(low.isin(*RESERVED), "reserved").when(F.col("name").isNull() | F.col("name").rlike(r"[/\\:\x00]|^\.") | (F.col("slug") == ""), "unsafe").when(~F.col("format").isin(*FORMATS), "unsupported")
    slim = written(files.sparkSession, rows.withColumn("status", own).drop("content"), "intake")
    known = existing.select("sha256").distinct().withColumn("_known", F.lit(True))
    slugs = existing.select(F.regexp_extract("case_id", rf"^{PREFIX}-\d+-(.*)$", 1).alias("slug")).distinct().withColumn("_taken", F.lit(True))
    fit = slim.filter("status IS NULL").join(known, "sha256", "left").join(slugs, "slug", "left")
    first = fit.groupBy("sha256").agg(F.min("name").alias("_first"))
    fit = fit.join(first, "sha256").withColumn("status", F.when(F.col("_known"), "archived").when(F.col("name") > F.col("_first"), "repeated"))
    fit = written(files.sparkSession, fit.drop("_known", "_first"), "intake")
    lead = fit.filter("status IS NULL").groupBy("slug").agg(F.min("name").alias("_lead"))
    done = fit.join(lead, "slug", "left").withColumn("status", F.coalesce("status", F.when(F.col("_taken") | (F.col("name") > F.col("_lead")), "taken"), F.lit("accepted")))
    return slim.filter("status IS NOT NULL").unionByName(done.drop("_taken", "_lead"))


def numbered(rows: DataFrame, order: str, start: int = 1) -> DataFrame:
    """Adds ``number``: start, start + 1, ... in the order of a column.

    Rows are sorted over all partitions and written; each partition then only needs the sum of the counts of those before it.
    """
    parts = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(rows.sparkSession, parts, "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start
    return placed.join(F.broadcast(before), "_part").withColumn("number", number).drop("_part", "_at", "_before")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Archived files (:data:`cases.SCHEMA`) without their contents."""
    spark.dataSource.register(CaseSource)
    return spark.read.format("cases").option("path", root).option("content", "false").load()


def archived(spark: SparkSession, root: str) -> DataFrame:
    """Archived files with their contents, each held against its hash."""
    spark.dataSource.register(CaseSource)
    return spark.read.format("cases").option("path", root).load()


def archive(files: DataFrame, root: str) -> DataFrame:
    """Takes the accepted of ``files`` (name, content) into the archive below ``root``, in one batch that is seen whole or not at all.

    Returns name, status and case_id (of those accepted). A case is named by the next free number and the file's name. Rows of
    one name must be one file: names that repeat are an error of the folder that they come from.
    """
    spark = files.sparkSession
    have = listing(spark, root)
    rows = checked(files, have)
    last = have.agg(F.max(F.regexp_extract("case_id", rf"^{PREFIX}-(\d+)-", 1).cast("long"))).first()[0] or 0
    named = numbered(rows.filter("status = 'accepted'"), "name", last + 1)
    named = written(spark, named.withColumn("case_id", F.concat(F.lit(f"{PREFIX}-"), F.when(F.length(F.col("number").cast("string")) < 4, F.lpad(F.col("number").cast("string"), 4, "0")).otherwise(F.col("number").cast("string")), F.lit("-"), "slug")), "intake-named")
    batch = files.join(named.select("name", "case_id", "format", "sha256"), "name").select("case_id", "name", "format", "sha256", F.length("content").cast("long").alias("n_bytes"), "content")
    batch.write.format("cases").option("path", root).mode("append").save()
    return rows.join(named.select("name", "case_id"), "name", "left").select("name", "status", "case_id")
