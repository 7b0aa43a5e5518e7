"""The ontology: vocabularies of atoms and relations, as plain values and as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the current ontology.
TYPES = ["problem", "bottleneck", "hypothesis", "method", "citation", "concept", "solution", "numerical", "conclusion", "component", "experiment", "verification"]
LEVELS = ["W1_problem", "W2_direction", "W3_approach", "W4_implementation", "W5_code"]
LEVEL_ALIASES = {"W1": "W1_problem", "W2": "W2_direction", "W3": "W3_approach", "W4": "W4_implementation", "W5": "W5_code"}
DEFAULT_TYPE = {"W1_problem": "problem", "W2_direction": "method", "W3_approach": "method", "W4_implementation": "solution", "W5_code": "component"}
HORIZONTAL = ["extends", "improves", "replaces", "adapts", "uses_component", "compares", "background", "implements", "validates", "boundary_of", "related_to"]
STRONG_CAUSAL = ["extends", "improves", "replaces", "adapts"]
HIERARCHY = ["aggregates_to", "decomposes_into"]
CATEGORIES = [
    "overestimation_bias", "training_instability", "sample_inefficiency", "exploration_exploitation", "credit_assignment", "catastrophic_forgetting", "scalability", "communication_overhead", "non_stationarity", "partial_observability", "multi_objective_conflict", "representational_limitation", "computational_cost", "generalization_gap",
]
TYPE_CHECKS = {"numerical": "I1", "citation": "I3", "method": "I4", "solution": "I4", "experiment": "I2"}
LEVEL_MIGRATIONS = {"W2_problem_analysis": "W1_problem", "W3_solution_direction": "W2_direction", "W4_concrete_solution": "W4_implementation", "W5_code_implementation": "W5_code"}
TYPE_MIGRATIONS = {"paper": "citation", "fact": "concept"}
MATRIX = {
    "extends": [("method", "method"), ("solution", "solution"), ("component", "component")],
    "improves": [("method", "method"), ("method", "bottleneck"), ("solution", "solution"), ("solution", "bottleneck")],
    "replaces": [("method", "method"), ("solution", "solution"), ("component", "component"), ("citation", "citation")],
    "adapts": [("method", "method"), ("solution", "solution"), ("method", "bottleneck"), ("solution", "bottleneck")],
    "uses_component": [("method", "component"), ("solution", "component")],
    "compares": [("method", "method"), ("solution", "solution"), ("experiment", "method"), ("experiment", "solution")],
    "implements": [("solution", "method"), ("component", "solution"), ("component", "method"), ("solution", "hypothesis")],
    "validates": [("verification", "hypothesis"), ("experiment", "hypothesis"), ("verification", "numerical"), ("verification", "method"), ("verification", "solution")],
    "boundary_of": [("concept", "method"), ("concept", "solution"), ("concept", "experiment"), ("numerical", "experiment")],
}
REQUIRED_PROVENANCE = {"numerical": "score", "citation": "raw_citation", "method": "*", "solution": "*", "experiment": "*"}
DEMOTIONS = {"numerical": "conclusion", "citation": "concept"}
TRUSTED_STATUSES = ["active", "verified", "skipped", "needs_review"]
PASSED_OVER_BY_AUDIT = ["needs_review", "transient", "demoted"]
LEVEL_WEIGHTS = {"W1_problem": 0.15, "W2_direction": 0.25, "W3_approach": 0.30, "W4_implementation": 0.20, "W5_code": 0.10}


def relation_name(c: Column) -> Column:
    """A relation in the ontology's spelling: lower case, one underscore between words."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[\s_-]+", "_")


def relation_letters(c: Column) -> Column:
    """A relation reduced to its letters, for comparison however it is spelled."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def lookup(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Value of ``mapping`` for ``c``; ``default`` (else null) where there is none."""
    out = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c) if mapping else F.lit(None).cast("string")
    return out if default is None else F.coalesce(out, default)


def level_ordinal(c: Column) -> Column:
    """0 for the topmost level to 4 for the lowest; null for an unknown level."""
    return F.when(c.isin(LEVELS), F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c).cast("int") - 1)


def matrix(spark: SparkSession) -> DataFrame:
    """Allowed pairs of types by relation: relation, src_type, tgt_type."""
    rows = [(r, *p) for r, pairs in MATRIX.items() for p in pairs]
    return spark.createDataFrame(rows, "relation string, src_type string, tgt_type string")


def levels(spark: SparkSession) -> DataFrame:
    """Levels with their ordinal."""
    return spark.createDataFrame(list(enumerate(LEVELS)), "ord int, level string")
