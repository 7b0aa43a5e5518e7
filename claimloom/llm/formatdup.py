"""Duplicates hidden by formatting differences (problem 5): progressive partition refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import letters_digits
from claimloom.plans.lineage import cut
from claimloom.plans.skew import hot_from_counts, salted_join

FIELDS = ["name", "type", "level"]


def payload_field(payload: Column, name: str) -> Column:
    """Field ``name`` of a serialised record, in any of its notations and orders.

    JSON objects (keys in any case), lines ``key: value`` and pairs ``key=value``
    between bars.
    """
    parsed = F.from_json(payload, "map<string,string>")
    lowered = F.transform_keys(F.map_filter(parsed, lambda k, v: F.lower(F.trim(k)) == name), lambda k, v: F.lit(name))
    lines = F.nullif(F.regexp_extract(payload, rf"(?im)^\h*\"?{name}\"?\h*:\h*([^\r\n]*)", 1), F.lit(""))
    bars = F.nullif(F.regexp_extract(payload, rf"(?i)(?:^|\|)\s*{name}\s*=\s*([^|\r\n]*)", 1), F.lit(""))
    first = F.map_values(lowered)[0]
    is_json = payload.rlike(r"^\s*\{")
    return F.when(is_json, first).otherwise(F.when(payload.rlike(rf"(?i)(^|\|)\s*(name|type|level)\s*="), bars).otherwise(lines))


def records(nodes: DataFrame, raw_atoms: DataFrame) -> DataFrame:
    """(id, name, type, level) of the atoms of cc_nodes and the records of raw_atoms."""
    raw = raw_atoms.select(F.col("raw_id").alias("id"), *[payload_field(F.col("payload"), f).alias(f) for f in FIELDS])
    return nodes.select(F.col("node_id").alias("id"), *FIELDS).unionByName(raw).where(F.col("id").isNotNull())


def histogram(whole: Column) -> Column:
    """Order-free invariant: how often each letter and digit stands in the stripped text, as a hash of its sorted characters."""
    return F.xxhash64(F.array_sort(F.split(whole, "")))


def refine(recs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(first_id, copy_id): records equal but for white space, case, punctuation and field order.

    Partition refinement with growing cost.  Stage 1 groups by lengths of the
    stripped fields; only for classes of several ids the letter histogram is made,
    and stage 2 groups by it; only for what then still shares a class the full key
    is made (128 bits of hash of the stripped fields, so that long ones don't
    travel), by which stage 3 groups.  Class sizes are counted before the shuffle; a
    class that holds a large share of all records is split over salts whenever its
    members are joined with it.

    first_id is the smallest id of the class, copy_id each other id.  An id with
    several records belongs to the class of each of its forms.  A null field
    counts as one without letters and digits; a record without any letters and
    digits in all fields is no copy of anything.  Empty input gives no rows.
    """
    fields = fields or FIELDS
    own = lambda i: F.col("bare")[i]
    n = range(len(fields))
    stripped = recs.select("id", F.array(*[letters_digits(F.coalesce(F.col(f), F.lit(""))) for f in fields]).alias("bare"))
    lengths = stripped.where(F.length(F.concat_ws("", "bare")) > 0).select("id", "bare", F.xxhash64(*[F.length(own(i)) for i in n]).alias("k1"))
    now = cut(lengths)
    now = cut(_shared(now, ["k1"]).select("id", "bare", "k1", histogram(F.concat_ws("", "bare")).alias("k2")))
    now = _shared(now, ["k1", "k2"]).select("id", F.xxhash64(*[own(i) for i in n]).alias("h1"), F.xxhash64(F.lit("second"), *[F.reverse(own(i)) for i in n]).alias("h2"))
    last = ["h1", "h2"]
    members = cut(now.groupBy(*last, "id").agg(F.lit(1).alias("x")).drop("x"))
    total = members.count()
    classes = members.groupBy(*last).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    hot = hot_from_counts(classes, last, "n", total)
    joined = salted_join(members, classes.where("n > 1").select(*last, "first_id"), last, "inner", total=total, hot=hot)
    return joined.where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id")).distinct()


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose class by ``key`` has several ids."""
    total = rows.count()
    classes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    hot = hot_from_counts(classes, key, "n", total)
    return salted_join(rows, classes.where(F.col("a") != F.col("b")).select(*key), key, "left_semi", total=total, hot=hot)


def copies_of(found: DataFrame) -> DataFrame:
    """One row per group of copies: first_id and the number of ids in the group."""
    return found.groupBy("first_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
