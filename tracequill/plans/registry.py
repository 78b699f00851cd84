"""Queries by name, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import case_queries, contract_queries, delta_queries, evidence_queries, fixtures, gate_queries, lineage_queries, quality_queries, rereview_queries, review_queries, term_queries, text_queries, tree_queries, units

_MODULES = (units, text_queries, evidence_queries, gate_queries, contract_queries, tree_queries, case_queries, rereview_queries, lineage_queries, term_queries, review_queries, delta_queries, quality_queries)

#: Queries whose branches or rounds read the units several times: these are parsed once and stored.
SEVERAL = (
    "a02_support_rate a10_exact_duplicate_groups g06_coverage_consensus g07_policy_status g12_targeted_plan g13_change_scope g14_delta_scope g14_downgrade_errors g14_outcomes "
    "g17_independence g20_report_reuse g21_quality_report j01_ledger_findings j07_near_duplicates j11_same_theme l07_controlled_quotes l08_deletion_only w09_lexicon_hits w10_greedy_merge"
).split()


def _held(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        with fixtures.held():
            return run(spark, sf_dir)

    return of


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _held(run) if name in SEVERAL else run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.article_units(spark, sf_dir)
