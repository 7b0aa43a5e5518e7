"""References to records that do not exist (problem 7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import present
from claimloom.plans.skew import hot_from_counts, salted_join


def orphan_references(edges: DataFrame, nodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """Every endpoint of an edge that names no atom, one that is deleted, or one that came later.

    Left anti-join in three steps: the distinct endpoint keys (counted before the
    shuffle, so a key with a third of all rows is one row) are held against the
    keys of atoms and of the log of deletions; only orphan keys are joined back to
    the references, and that join is salted by the counts already made.

    Columns: src, tgt, relation (as written), side (``src``/``tgt``), orphan_kind
    (``late``: the atom was created after the edge; ``deleted``; ``missing``),
    created_at (earliest of the edge key).  One row per edge key and side.

    Null and blank endpoints are no references.  An edge without created_at can't
    be ``late``, nor can one whose atom has no created_at.  Repeated rows of an
    edge key count once, with the earliest created_at.  An atom with several rows
    counts with its earliest created_at.  Empty tables give an empty result (with
    no atoms every reference is an orphan).  Columns beyond those named are
    ignored.
    """
    e = edges.groupBy("src", "tgt", "relation").agg(F.min("created_at").alias("created_at"))
    sides = F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("id")), F.struct(F.lit("tgt").alias("side"), F.col("tgt").alias("id")))
    refs = e.select("*", F.explode(sides).alias("r")).select("src", "tgt", "relation", "created_at", "r.side", "r.id")
    raw = edges.select("created_at", F.explode(F.array("src", "tgt")).alias("id"))
    return _orphans(refs, raw, nodes, deleted, 2 * edges.count()).select("src", "tgt", "relation", "side", "orphan_kind", "created_at")


def orphan_decisions(decisions: DataFrame, nodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """The same for canonical_id, parent_id and each of dup_ids of merge decisions, whether accepted or not.

    Columns: decision_id, id, side (the column), orphan_kind, created_at (earliest
    decided_at).  One row per decision, side and id.
    """
    one = lambda c: F.struct(F.lit(c).alias("side"), F.col(c).alias("id"))
    dups = F.transform(F.coalesce("dup_ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit("dup_ids").alias("side"), x.alias("id")))
    raw = decisions.select("decision_id", F.col("decided_at").alias("created_at"), F.explode(F.concat(F.array(one("canonical_id"), one("parent_id")), dups)).alias("r")).select("decision_id", "created_at", "r.side", "r.id")
    refs = raw.groupBy("decision_id", "side", "id").agg(F.min("created_at").alias("created_at"))
    return _orphans(refs, raw, nodes, deleted, raw.count()).select("decision_id", "id", "side", "orphan_kind", "created_at")


def _orphans(refs: DataFrame, raw: DataFrame, nodes: DataFrame, deleted: DataFrame, total: int) -> DataFrame:
    """References (id, created_at and more) that are orphans, with orphan_kind; ``raw``: (id, created_at) before repeated rows go."""
    keys = raw.where(present(F.col("id"))).groupBy("id").agg(F.min("created_at").alias("first_ref"), F.count(F.lit(1)).alias("n"))
    atoms = nodes.where(F.col("node_id").isNotNull()).groupBy(F.col("node_id").alias("id")).agg(F.min("created_at").alias("born"), F.lit(True).alias("held"))
    gone = deleted.where(F.col("node_id").isNotNull()).select(F.col("node_id").alias("id")).distinct()
    absent = keys.join(atoms, "id", "left_anti").select("id", F.lit(None).cast(dict(nodes.dtypes)["created_at"]).alias("born"))
    dead = absent.join(gone, "id", "left_semi").withColumn("orphan_kind", F.lit("deleted"))
    missing = absent.join(gone, "id", "left_anti").withColumn("orphan_kind", F.lit("missing"))
    late = keys.join(atoms, "id").where(F.col("born") > F.col("first_ref")).select("id", "born", F.lit("late").alias("orphan_kind"))
    orphans = dead.unionByName(missing).unionByName(late)
    hot = hot_from_counts(keys, ["id"], "n", total)
    back = salted_join(refs.where(present(F.col("id"))), orphans, ["id"], "inner", total=total, hot=hot)
    return back.where((F.col("orphan_kind") != "late") | (F.col("created_at") < F.col("born")))


def orphan_report(**tables: DataFrame) -> DataFrame:
    """Orphan references per table, side, kind and month of the referring row (``unknown`` without a time)."""
    parts = [t.select(F.lit(name).alias("table_name"), "side", "orphan_kind", "created_at") for name, t in tables.items()]
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("unknown"))
    return reduce(DataFrame.unionByName, parts).groupBy("table_name", "side", "orphan_kind", month.alias("month")).agg(F.count(F.lit(1)).alias("n_references"))
