"""Set distances and novelty of a proposal against known trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import ontology as O
from claimloom.ontology import LEVEL_WEIGHTS, lookup
from claimloom.plans.ship import ship

#: Vectors of a proposal that go to the workers at once.
QUERY_BLOCK = 4_096


def _units(vectors) -> np.ndarray:
    m = np.array(list(vectors), dtype=np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


def _blocks(spark, rows) -> Iterator:
    """Rows of a query set, broadcast in blocks of at most ``QUERY_BLOCK``."""
    block = []
    for row in rows:
        block.append(row)
        if len(block) == QUERY_BLOCK:
            yield spark.sparkContext.broadcast(block)
            block = []
    if block:
        yield spark.sparkContext.broadcast(block)


def farthest(known: DataFrame, proposal: DataFrame) -> DataFrame:
    """(level, ib, distance): for each known atom (level, ib, vb) the largest cosine distance to the proposal's (level, va).

    Against a set of one atom this is the Hausdorff distance.  The proposal is the
    stated query set: it goes to the workers in blocks of ``QUERY_BLOCK`` vectors, and
    known atoms stay where they are; only one number per atom and block is combined.
    """
    spark = known.sparkSession
    ship(spark)
    sent = list(_blocks(spark, ((r[0], [float(x) for x in r[1]]) for r in proposal.select("level", "va").toLocalIterator())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in sent:
                by: dict = {}
                for level, v in block.value:
                    by.setdefault(level, []).append(v)
                for level, rows in pdf.groupby("level"):
                    if level in by:
                        yield pd.DataFrame({"level": level, "ib": rows["ib"].to_numpy(), "distance": (1 - _units(rows["vb"]) @ _units(by[level]).T).max(axis=1)})

    return known.select("level", "ib", "vb").mapInPandas(run, "level string, ib string, distance double").groupBy("level", "ib").agg(F.max("distance").alias("distance"))


def hausdorff_to(points: DataFrame, by: str, base: DataFrame) -> DataFrame:
    """(by, distance): Hausdorff distance of each group of ``points`` (by, v) from one set ``base`` (v).

    ``base`` is the stated query set and goes to the workers in blocks; the points
    stay where they are.  Of each batch only the smallest distances leave a task: one
    per point, and one per group and vector of the base.
    """
    spark = points.sparkSession
    ship(spark)
    kind = dict(points.dtypes)[by]
    sent = list(_blocks(spark, ([float(x) for x in r[0]] for r in base.select("v").toLocalIterator())))
    if not sent:
        return points.select(by, F.lit(0.0).alias("distance")).limit(0)
    numbered = points.select(by, "v", F.monotonically_increasing_id().alias("id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, rows in pdf.groupby(by):
                m = _units(rows["v"])
                for i, block in enumerate(sent):
                    d = 1 - m @ _units(block.value).T
                    yield pd.DataFrame({by: g, "side": "a", "id": rows["id"].to_numpy(), "m": d.min(axis=1)})
                    yield pd.DataFrame({by: g, "side": "b", "id": i * QUERY_BLOCK + np.arange(d.shape[1]), "m": d.min(axis=0)})

    near = numbered.mapInPandas(run, f"{by} {kind}, side string, id bigint, m double").groupBy(by, "side", "id").agg(F.min("m").alias("m"))
    return near.groupBy(by).agg(F.max("m").alias("distance"))


def hausdorff(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Hausdorff distance per key from pairs (by, ia, ib, d): the largest of the smallest distances, both ways."""
    one = pairs.groupBy(*by, "ia").agg(F.min("d").alias("m")).groupBy(*by).agg(F.max("m").alias("x"))
    two = pairs.groupBy(*by, "ib").agg(F.min("d").alias("m")).groupBy(*by).agg(F.max("m").alias("y"))
    return one.join(two, by).select(*by, F.greatest("x", "y").alias("distance"))


def with_empty_sets(distances: DataFrame, n_a: str, n_b: str) -> DataFrame:
    """Conventions: two empty sets are at 0, an empty and a full one at 1."""
    a, b = F.coalesce(F.col(n_a), F.lit(0)), F.coalesce(F.col(n_b), F.lit(0))
    return distances.withColumn("distance", F.when((a == 0) & (b == 0), 0.0).when((a == 0) | (b == 0), 1.0).otherwise(F.col("distance")))


def weighted_total(distances: DataFrame, by: list[str]) -> DataFrame:
    """Sum of level distances by level weight (0.2 for an unknown level)."""
    w = F.coalesce(lookup(F.col("level"), {k: str(v) for k, v in LEVEL_WEIGHTS.items()}).cast("double"), F.lit(0.2))
    return distances.groupBy(*by).agg(F.sum(F.col("distance") * w).alias("total"))


def trajectory_distances(members: DataFrame, per: DataFrame, proposal_levels: DataFrame) -> DataFrame:
    """(trajectory, level, distance) at all five levels, an empty side counting as in ``with_empty_sets``.

    ``members``: (trajectory, level, ib), at most one per level; ``per``: (ib,
    distance) of the atoms whose level the proposal has; ``proposal_levels``: (level).
    """
    levels = F.broadcast(O.levels(members.sparkSession).select("level"))  # fixed values
    mine = F.broadcast(proposal_levels.select("level").distinct().withColumn("na", F.lit(1)))  # five levels at most
    full = members.select("trajectory").distinct().join(levels).join(mine, "level", "left")
    held = members.join(per.select("ib", "distance"), "ib", "left").select("trajectory", "level", "distance", "usable")
    both = full.join(held, ["trajectory", "level"], "left")
    return with_empty_sets(both, "na", "usable").select("trajectory", "level", "distance")


def last_wins(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Of several rows of a key, the last in the given order; null orders come first."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(*order)).alias("__m")).select(*by, "__m.*")


def score(total):
    """1 - min(total / 10, 1), to four places; a larger distance lowers it, so the raw distance is kept beside it."""
    return F.round(1 - F.least(total / 10, F.lit(1.0)), 4)


def nearest(totals: DataFrame) -> DataFrame:
    """The known trajectory nearest to the proposal: smallest total, then smallest id (one row)."""
    return totals.agg(F.min(F.struct(F.round("total", 9).alias("total"), "trajectory")).alias("m")).where("m is not null").select("m.trajectory", F.round("m.total", 6).alias("distance"), score(F.col("m.total")).alias("score"))
