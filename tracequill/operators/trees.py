"""Free-form JSON documents of any depth, walked by a frontier of exploded variants.

A step replaces every container by its children and passes leaves on; ``STEPS`` steps are one
narrow plan without a shuffle. What then still holds containers is written and walked
on, so documents may be nested as deep as the parser allows, and only the deep ones cost more rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.functions import text as T
from tracequill.session import written

STEPS = 8
#: Keys whose texts a reader sees, and keys that name evidence or blocks (one, or a list).
TEXT_KEYS = ("title", "subtitle", "summary", "lead", "text", "label", "attribution")
EVIDENCE_KEYS = {"evidenceRef": 0, "evidenceRefs": 1, "matchedEvidenceRefs": 1}
BLOCK_KEYS = {"readerBlockRef": 0, "readerBlockRefs": 1}


def _step(rows: DataFrame, keys: list[str]) -> DataFrame:
    children = rows.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_pos", "_name", "_child")
    each = rows.lateralJoin(children)
    inside, named = F.col("_pos").isNotNull(), F.col("_name").isNotNull()
    name = F.replace(F.replace(F.coalesce("_name", F.col("_pos").cast("string")), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return each.select(
        *keys, F.when(inside, F.concat("_path", F.lit("/"), name)).otherwise(F.col("_path")).alias("_path"), F.when(named, F.col("_name")).otherwise(F.col("_key")).alias("_key"),
        F.when(named, 0).when(inside, F.col("_hops") + 1).otherwise(F.col("_hops")).alias("_hops"), F.coalesce("_child", "_v").alias("_v"),
    )


def leaves(docs: DataFrame, keys: list[str], json: str = "json", steps: int = STEPS) -> DataFrame:
    """``keys`` of each document, and of each of its leaves: ``path`` (a JSON pointer), ``key`` (of the nearest object, '' at
    the top), ``hops`` (lists between that key and the leaf), ``kind`` and ``value`` (of strings).

    Empty lists and objects are leaves; a null document has one of kind null; text that is no JSON is an error.
    """
    spark, none = docs.sparkSession, F.lit("")
    rows = docs.select(*keys, none.alias("_path"), none.alias("_key"), F.lit(0).alias("_hops"), F.parse_json(json).alias("_v"))
    done = None
    while True:
        for _ in range(steps):
            rows = _step(rows, keys)
        kind = F.schema_of_variant("_v")
        open_ = F.coalesce((kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~F.to_json("_v").isin("[]", "{}"), F.lit(False))
        rows = written(spark, rows.withColumn("_open", open_), "tree")
        some = rows.filter("NOT _open")
        done = some if done is None else done.unionByName(some)
        rows = rows.filter("_open")
        if rows.isEmpty():
            break
        rows = rows.drop("_open")
    kind = F.regexp_replace(F.lower(F.coalesce(F.schema_of_variant("_v"), F.lit("null"))), "[<(].*", "")
    kind = F.when(kind == "void", "null").when(kind.isin("bigint", "decimal", "double"), "number").otherwise(kind)
    return done.select(*keys, F.col("_path").alias("path"), F.col("_key").alias("key"), F.col("_hops").alias("hops"), kind.alias("kind"), F.when(kind == "string", F.expr("try_variant_get(_v, '$', 'string')")).alias("value"))


def block_characters(found: DataFrame, keys: list[str]) -> DataFrame:
    """Characters without white space of all texts under :data:`TEXT_KEYS`, in lists of any depth too. ``found``: :func:`leaves`."""
    own = F.when(F.col("key").isin(*TEXT_KEYS), T.compact_characters(F.col("value"))).otherwise(0)
    return found.groupBy(*keys).agg(F.sum(own).cast("long").alias("characters"))


def _under(names: dict[str, int]) -> Column:
    test = F.lit(False)
    for name, hops in names.items():
        test = test | ((F.col("key") == name) & (F.col("hops") == hops))
    return test & (F.col("kind") == "string")


def references(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``target`` (evidence or block) and ``ref``: each reference of a document once. ``found``: :func:`leaves`."""
    target = F.when(_under(EVIDENCE_KEYS), "evidence").when(_under(BLOCK_KEYS), "block")
    return found.withColumn("target", target).filter("target IS NOT NULL").select(*keys, "target", F.col("value").alias("ref")).distinct()
