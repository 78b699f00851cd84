"""Reader reviews: the gate of one review, the pair of a borderline review, and its ruling. Row-local but for joins of reviews of one document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claimreview import blank, yes
from .gates import listed


@dataclass(frozen=True)
class Policy:
    """Weights by dimension; the core ones weigh 2, all others 1."""

    weights: dict[str, int]
    core: tuple[str, ...]
    clean: int = 4
    borderline: int = 3
    average: float = 3.8
    most_threes: int = 2

    def __post_init__(self):
        if len(self.core) != 3 or len(set(self.core)) != 3 or not set(self.core) <= set(self.weights):
            raise ValueError("three different known dimensions are core")
        if any(w != (2 if d in self.core else 1) for d, w in self.weights.items()):
            raise ValueError("core dimensions weigh 2, others 1")
        if self.clean != 4 or self.borderline != 3 or not 3 <= self.average <= 5 or not 0 <= self.most_threes <= len(self.weights):
            raise ValueError("thresholds out of their ranges")


def _score(dimension: str) -> Column:
    return F.element_at("scores", dimension)


def _valid(dimension: str) -> Column:
    return yes(_score(dimension).between(1, 5))


def failures(reviews: DataFrame, dimensions: list[str], least: int = 4) -> DataFrame:
    """Adds ``passed`` and ``failing`` (dimensions scored below ``least``, in order) of the plain gate.

    Columns: verdict, scores (map of text to int), severities (of its issues). No score is no failing one.
    """
    failing = listed([(d, _score(d) < least) for d in dimensions])
    error = F.array_contains(F.coalesce("severities", F.array().cast("array<string>")), "error")
    return reviews.withColumn("failing", failing).withColumn("passed", yes(F.col("verdict") == "pass") & (F.size("failing") == 0) & ~yes(error))


def evaluated(reviews: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``classification`` (clean_pass, borderline, revise), ``average`` (of valid scores; none: 0), ``reasons`` and ``declared`` (whether the verdict says the same)."""
    dims = list(policy.weights)
    held = lambda test: listed([(d, _valid(d) & test(d)) for d in dims])
    total = lambda value: sum((F.when(_valid(d), value(d)).otherwise(0) for d in dims), F.lit(0))
    weight = total(lambda d: F.lit(policy.weights[d]))
    rows = reviews.withColumn("_invalid", listed([(d, ~_valid(d)) for d in dims])).withColumn("_ones", held(lambda d: _score(d) == 1)).withColumn("_low", held(lambda d: _score(d) < policy.borderline))
    rows = rows.withColumn("_core", held(lambda d: F.lit(d in policy.core) & (_score(d) <= 2))).withColumn("_threes", total(lambda d: (_score(d) == 3).cast("int")))
    rows = rows.withColumn("average", F.when(weight > 0, total(lambda d: _score(d) * policy.weights[d]) / weight).otherwise(F.lit(0.0)))
    error = yes(F.array_contains("severities", "error"))
    sound = (F.size("_invalid") == 0) & ~error
    least = F.least(*(_score(d) for d in dims))
    clean = sound & (least >= policy.clean)
    middling = sound & (F.size("_low") == 0) & (F.col("average") >= policy.average) & (F.col("_threes") <= policy.most_threes)
    rows = rows.withColumn("classification", F.when(clean, "clean_pass").when(middling, "borderline").otherwise("revise"))
    revised = F.col("classification") == "revise"
    named = lambda name, c, when: F.when(when & (F.size(c) > 0), F.concat(F.lit(name + ":"), F.array_join(c, ",")))
    reasons = F.array_compact(
        F.array(
            named("invalid_scores", "_invalid", F.lit(True)), F.when(error, "error_issue"), named("score_1", "_ones", F.lit(True)), named("core_score_2", "_core", F.lit(True)),
            named("below_borderline", "_low", revised & (F.size("_ones") == 0) & (F.size("_core") == 0)),
            F.when(revised & (F.col("average") < policy.average), "low_average"), F.when(revised & (F.col("_threes") > policy.most_threes), "too_many_threes"),
        )
    )
    return rows.withColumn("reasons", reasons).withColumn("declared", yes(F.col("verdict") == F.col("classification"))).drop("_invalid", "_ones", "_low", "_core", "_threes")


def pairs(primary: DataFrame, secondary: DataFrame, policy: Policy) -> DataFrame:
    """case_id, status and ``disputed`` dimensions of each first review and its second one.

    A review that is not borderline needs no second (status ``settled``, or ``not_allowed`` where there is one). Borderline ones are
    ``needs_secondary``, ``pass`` where both say the same, else ``needs_adjudication`` over the dimensions scored differently.
    """
    mine = evaluated(primary, policy).select("case_id", F.col("classification").alias("c1"), F.col("scores").alias("s1"))
    other = evaluated(secondary, policy).select("case_id", F.col("classification").alias("c2"), F.col("scores").alias("s2"))
    rows = mine.join(other, "case_id", "left")
    status = (
        F.when(F.col("c1") != "borderline", F.when(F.col("c2").isNull(), "settled").otherwise("not_allowed"))
        .when(F.col("c2").isNull(), "needs_secondary")
        .when(F.col("c2") == F.col("c1"), "pass")
        .otherwise("needs_adjudication")
    )
    differ = listed([(d, ~F.element_at("s1", d).eqNullSafe(F.element_at("s2", d))) for d in policy.weights])
    return rows.withColumn("status", status).select("case_id", "c1", "c2", "status", F.when(F.col("status") == "needs_adjudication", differ).otherwise(F.array().cast("array<string>")).alias("disputed"))


def ruling_errors(rulings: DataFrame, paired: DataFrame, assigned: DataFrame) -> DataFrame:
    """(case_id, error) of rulings on pairs.

    ``rulings``: case_id, reviewer_id, blind, decision, disputed, rationale. ``assigned``: case_id, adjudicator,
    readers (array of the two reviewers' ids).
    """
    rows = rulings.join(paired.select("case_id", "status", F.col("disputed").alias("_due")), "case_id", "left").join(assigned, "case_id", "left")
    said = F.coalesce("disputed", F.array().cast("array<string>"))
    rules = [
        ("not_blind", ~yes(F.col("blind"))),
        ("not_assigned", ~yes(F.col("reviewer_id") == F.col("adjudicator"))),
        ("not_independent", yes(F.array_contains("readers", F.col("reviewer_id")))),
        ("decision", ~yes(F.col("decision").isin("pass", "revise"))),
        ("not_needed", ~yes(F.col("status") == "needs_adjudication")),
        ("dimensions", (F.size(F.array_distinct(said)) < F.size(said)) | ~F.array_sort(said).eqNullSafe(F.array_sort("_due"))),
        ("rationale", blank(F.col("rationale"))),
    ]
    return rows.select("case_id", F.explode(listed(rules)).alias("error"))
