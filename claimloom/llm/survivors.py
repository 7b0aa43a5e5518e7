"""Best representative of each duplicate group (problem 1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import has_value
from claimloom.plans.skew import salted_join

FIELDS = ["context", "code_ref", "code_body", "source_pdf"]
#: Default order of ranking.
RANK = ["version", "recency"]
#: Statuses from the most to the least trusted.
TRUST = ["verified", "active", "skipped", "needs_review", "low_confidence", "low_reliability", "demoted", "transient", "merged"]


def members_of(groups: DataFrame) -> DataFrame:
    """(node_id, group_id) of all members, the smallest of each group included."""
    return groups.select(F.col("member_id").alias("node_id"), "group_id").unionByName(groups.select(F.col("group_id").alias("node_id"), "group_id").distinct())


def _ranks(fields: list[str], trust: list[str]) -> dict[str, Column]:
    """What records may be ranked by, as columns of which larger is better and null worst."""
    place = F.array_position(F.array(*[F.lit(t) for t in trust]), F.lower("status"))
    return {
        "completeness": reduce(lambda a, b: a + b, [has_value(F.col(f)).cast("int") for f in fields]),
        "trust": -F.nullif(place, F.lit(0)),
        "version": F.col("version"),
        "recency": F.col("updated_at"),
    }


def field_winners(nodes: DataFrame, groups: DataFrame, fields: list[str] | None = None, *, rank: list[str] | None = None, trust: list[str] | None = None, with_value: bool = False) -> DataFrame:
    """For each group and field the row of cc_nodes that gives the value.

    Records are ranked per group and field among the rows in which the field has a
    value, by ``rank`` in turn and then by smallest node_id: ``version`` (highest),
    ``recency`` (latest updated_at), ``completeness`` (most fields with a value) or
    ``trust`` (earliest status in ``trust``; others last).  Nulls rank last.
    ``row_number() = 1`` lets Spark keep only the best row per partition before the
    shuffle, so a group with a third of all rows is small by the time it meets in
    one task.

    Columns: group_id, field_name, node_id (and value).  Null, blank and stand-in
    values are no values; no value, no row.  Ties in all keys are rows of one atom:
    the greatest value wins.  Groups without rows give nothing; repeated rows change
    nothing; columns of ``nodes`` beyond those named are ignored.
    """
    fields, rank = fields or FIELDS, rank or RANK
    ranks = _ranks(fields, trust or TRUST)
    keys = [f"__r{i}" for i in range(len(rank))]
    rows = nodes.where(F.col("node_id").isNotNull()).select("node_id", *[ranks[r].alias(k) for r, k in zip(rank, keys, strict=True)], *fields)
    mine = salted_join(rows, members_of(groups), ["node_id"], "inner", total=nodes.count())
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("x")
    long = mine.select("group_id", "node_id", *keys, each).select("group_id", "node_id", *keys, "x.field_name", "x.value").where(has_value(F.col("value")))
    if not with_value:
        long = long.drop("value")
    best = Window.partitionBy("group_id", "field_name").orderBy(*[F.col(k).desc_nulls_last() for k in keys], F.col("node_id"), *([F.col("value").desc()] if with_value else []))
    return long.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("group_id", "field_name", "node_id", *(["value"] if with_value else []))


def survivors(nodes: DataFrame, groups: DataFrame, fields: list[str] | None = None, **named) -> DataFrame:
    """One record per group, built field by field from the best rows: group_id and the fields; ``named`` as in ``field_winners``.

    A group without any value has no record; a field without a value is null.
    """
    fields = fields or FIELDS
    won = field_winners(nodes, groups, fields, with_value=True, **named)
    return won.groupBy("group_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields])
