"""Nested reader documents: flattening to leaves, and leaf predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.functions import text as T

NODE = "struct<id:string,text:string,provenance:string,evidence_refs:array<string>,citation_refs:array<string>>"
BLOCK = "struct<id:string,type:string,provenance:string,evidence_refs:array<string>,citation_refs:array<string>,nodes:array<" + NODE + ">>"
DOCUMENT = f"array<struct<id:string,modules:array<struct<id:string,blocks:array<{BLOCK}>>>>>"


def flatten(documents: DataFrame) -> DataFrame:
    """Leaves of (case_id, sections: ``DOCUMENT``) in reading order.

    A node without refs or provenance of its own has its block's. Of ids that occur twice
    the last definition stays; ``repeated`` tells.
    """
    rows = documents.select("case_id", F.posexplode("sections").alias("s", "section")).select("case_id", "s", "section.id", F.posexplode("section.modules").alias("m", "module"))
    rows = rows.select("case_id", "s", "m", F.col("id").alias("section_id"), F.col("module.id").alias("module_id"), F.posexplode("module.blocks").alias("b", "block"))
    rows = rows.select("case_id", "s", "m", "b", "section_id", "module_id", "block", F.posexplode("block.nodes").alias("n", "node"))

    def own(name: str) -> Column:
        return F.when(F.size(F.col(f"node.{name}")) > 0, F.col(f"node.{name}")).otherwise(F.coalesce(F.col(f"block.{name}"), F.array().cast("array<string>"))).alias(name)

    leaves = rows.select(
        "case_id", F.struct("s", "m", "b", "n").alias("at"), F.col("node.id").alias("id"), F.col("node.text").alias("text"), "section_id", "module_id",
        F.col("block.id").alias("block_id"), F.col("block.type").alias("type"), F.coalesce("node.provenance", "block.provenance").alias("provenance"), own("evidence_refs"), own("citation_refs"),
    )
    last = leaves.groupBy("case_id", "id").agg(F.max_by(F.struct(*[c for c in leaves.columns if c not in ("case_id", "id")]), "at").alias("x"), (F.count(F.lit(1)) > 1).alias("repeated"))
    return last.select("case_id", "id", "repeated", "x.*")


def eligible(leaves: DataFrame) -> DataFrame:
    """Leaves that count for coverage: prose, lists and quotes of overview and themes with sourced provenance."""
    return leaves.filter(F.col("section_id").isin("overview", "themes") & F.col("type").isin("prose_group", "structured_list", "quote") & F.col("provenance").isin("source_fact", "speaker_view"))


def fidelity_leaves(leaves: DataFrame, provenances: tuple[str, ...] = ("source_fact", "speaker_view", "external", "editorial")) -> DataFrame:
    """Leaves under fidelity review: four provenances, or ``system`` with any reference."""
    refs = (F.size("evidence_refs") > 0) | (F.size("citation_refs") > 0)
    return leaves.filter(F.col("provenance").isin(*provenances) | ((F.col("provenance") == "system") & refs))


def reference_free(leaves: DataFrame) -> DataFrame:
    """What blind reviewers see: no references, in ids or in the text."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"\s*[\[(（](?:[ERC]\d{3,}(?:\s*[,–-]\s*)?)+[\])）]", ""), r" {2,}", " "))
    return leaves.select("case_id", "id", text.alias("text"), "type")


def quote_errors(leaves: DataFrame, spans: DataFrame, least: int = 6) -> DataFrame:
    """(case_id, leaf_id, quote) quotes that are too short or not in their leaf, compared in normalised form."""
    joined = spans.join(leaves.select("case_id", F.col("id").alias("leaf_id"), "text"), ["case_id", "leaf_id"], "left")
    quote = T.normalized_claim(F.col("quote"))
    error = F.when(F.col("text").isNull(), "unknown_leaf").when(F.length(quote) < least, "too_short").when(~F.contains(T.normalized_claim(F.col("text")), quote), "not_in_leaf")
    return joined.withColumn("error", error).filter("error IS NOT NULL").select("case_id", "leaf_id", "error")
