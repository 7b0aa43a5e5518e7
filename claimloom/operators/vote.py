"""Majority votes over repeated samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _modal(samples: DataFrame, by: list[str], vote: Column, order: list[Column], value: str) -> DataFrame:
    """The value of the most frequent vote; ties go to the vote seen first."""
    s = samples.where(F.col(value).isNotNull()).withColumn("__vote", vote)
    first = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    counts = s.groupBy(*by, "__vote").agg(F.count(F.lit(1)).alias("votes"), F.min(first).alias("__first"), F.min_by(value, first).alias(value))
    best = Window.partitionBy(*by).orderBy(F.col("votes").desc(), "__first")
    return counts.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(*by, value, "votes")


def vote_scalar(samples: DataFrame, by: list[str], value: str, order: list[Column]) -> DataFrame:
    """Modal scalar per key: floats vote by their value rounded to 4 places, null loses to any value, ties to the first seen."""
    kind = dict(samples.dtypes)[value]
    vote = F.round(F.col(value), 4) if kind in ("double", "float") else F.col(value)
    return _modal(samples, by, vote, order, value)


def vote_list(samples: DataFrame, by: list[str], value: str, order: list[Column]) -> DataFrame:
    """List of the modal length per key, the first seen of that length."""
    return _modal(samples, by, F.size(F.col(value)), order, value)


def vote_nested(samples: DataFrame, by: list[str], record: str, order: list[Column]) -> DataFrame:
    """Vote per key of a map column, each on its own: (by, key, value, votes)."""
    flat = samples.select(*by, *[c.alias(f"__o{i}") for i, c in enumerate(order)], F.explode(record).alias("key", "value"))
    return vote_scalar(flat, [*by, "key"], "value", [F.col(f"__o{i}") for i in range(len(order))])
