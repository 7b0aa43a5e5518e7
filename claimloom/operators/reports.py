"""Tallies of the graph: levels, relations, statuses, duplicates, report cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom import ontology as O


def level_counts(atoms: DataFrame) -> DataFrame:
    """(level, n) of all five levels, 0 where there are no atoms."""
    n = atoms.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return O.levels(atoms.sparkSession).join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def tallies(df: DataFrame, *by: str) -> DataFrame:
    """Rows per value of ``by``."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def dedup_rate(atoms: DataFrame) -> DataFrame:
    """Share of merged atoms per level."""
    return atoms.groupBy("level").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "merged").alias("merged")).withColumn("rate", F.round(F.col("merged") / F.col("total"), 6))


def cards(atoms: DataFrame, label: str) -> DataFrame:
    """Report cards: per label and status the number and percent of the label's atoms."""
    n = tallies(atoms, label, "status")
    per = Window.partitionBy(label)
    return n.withColumn("percent", F.round(100 * F.col("n") / F.greatest(F.sum("n").over(per), F.lit(1)), 2))


def cpr_band(cpr):
    """Colour band of a verified share."""
    return F.when(cpr >= 0.8, "good").when(cpr >= 0.5, "fair").otherwise("poor")


def audit_cards(per_atom: DataFrame, label: str) -> DataFrame:
    """One card per label of verdicts (label, type, status, checks): numbers, failures per check, the share of numerical atoms verified and its band."""
    num, ok = F.col("type") == "numerical", F.col("status") == "verified"
    audited = F.size("checks") > 0
    share = F.coalesce(F.try_divide(F.count_if(num & ok & audited), F.count_if(num & audited)), F.lit(0.0))
    fails = [F.count_if(F.coalesce(F.element_at("checks", F.lit(c)) == "failed", F.lit(False))).alias(f"failed_{c.lower()}") for c in ("I1", "I2", "I3", "I4")]
    out = per_atom.groupBy(label).agg(F.count_if(audited).alias("n_audited"), F.count_if(audited & ok).alias("n_passed"), F.count_if(audited & ~ok).alias("n_failed"), F.count_if(~audited).alias("n_skipped"), share.alias("cpr"), *fails)
    return out.withColumn("band", cpr_band(F.col("cpr"))).withColumn("cpr", F.round("cpr", 6))
