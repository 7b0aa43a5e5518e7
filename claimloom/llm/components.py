"""Consolidating pairwise matches into groups (problem 6): alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import present
from claimloom.plans.lineage import cut, forget
from claimloom.plans.skew import hot_from_counts, salted_join


def decision_links(decisions: DataFrame) -> DataFrame:
    """Distinct links (hi, lo) between canonical_id and each id of dup_ids of accepted decisions.

    Null and blank ids are left out; a link of an id to itself is none.  Decisions
    whose do_merge is false or null, and those with null or empty dup_ids, give no
    links.
    """
    one = decisions.where(F.col("do_merge") & present(F.col("canonical_id"))).select(F.col("canonical_id").alias("a"), F.explode("dup_ids").alias("b"))
    return canonical(one.where(present(F.col("b"))))


def canonical(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different ids as (hi, lo) with hi > lo."""
    return pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def large_star(links: DataFrame, total: int) -> DataFrame:
    """Each node points its larger neighbours to the smallest id among itself and its neighbours.

    The smallest neighbour and the number of neighbours come from one aggregation
    that is combined before its shuffle; nodes with very many larger neighbours are
    split over salts when the answer is joined back.
    """
    ends = links.select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit(1).alias("larger")).unionByName(links.select(F.col("hi").alias("u"), F.col("lo").alias("v"), F.lit(0).alias("larger")))
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.sum("larger").alias("n"))
    hot = hot_from_counts(least.withColumnRenamed("u", "lo"), ["lo"], "n", total)
    small = least.where("n > 0").select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
    return salted_join(links, small, ["lo"], "inner", total=total, hot=hot).select("hi", F.col("m").alias("lo"))


def small_star(links: DataFrame, total: int) -> DataFrame:
    """Each node points its smaller neighbours and itself to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
    hot = hot_from_counts(least, ["hi"], "n", total)
    several = least.where("n > 1").select("hi", "m")
    inner = salted_join(links, several, ["hi"], "inner", total=total, hot=hot).where(F.col("lo") != F.col("m")).select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return canonical(inner.unionByName(least.select(F.col("hi").alias("a"), F.col("m").alias("b"))))


def star_groups(links: DataFrame) -> DataFrame:
    """(group_id, member_id) of every linked id but the smallest of its group.

    Large-star and small-star rewrites alternate until the links stay the same;
    then every id is linked to the smallest id of its component.  The links are
    written to the checkpoint folder after each round, and whether they changed is
    told by their number and an order-free checksum; no ids reach the driver.

    Ids compare as strings.  No links give no rows; repeated links count once.
    """
    now = cut(links.select("hi", "lo").distinct())
    before = _fingerprint(now)
    while before[0]:
        total = before[0]
        last, now = now, cut(small_star(large_star(now, total).distinct(), total))
        forget(last)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    return now.select(F.col("lo").alias("group_id"), F.col("hi").alias("member_id"))


def _fingerprint(links: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def groups_of_decisions(decisions: DataFrame) -> DataFrame:
    """(group_id, member_id) of the atoms that accepted decisions link, directly or not."""
    return star_groups(decision_links(decisions))
