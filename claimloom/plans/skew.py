"""Joins that stay balanced when single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1/HOT_PARTS of the rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 256
#: Below so many rows a key is never worth salting.
HOT_ROWS = 20_000
SALT = "__salt"
_N = "__n_salts"


def hot_threshold(total: int) -> int:
    """Rows from which a key counts as hot in a table of ``total`` rows."""
    return max(HOT_ROWS, total // HOT_PARTS)


def hot_from_counts(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Hot keys with their number of salts, from a table of rows per key.

    At most ``total / hot_threshold(total) <= HOT_PARTS`` keys can pass the filter,
    so the result may be broadcast whatever the size of the input.
    """
    bar = hot_threshold(total)
    salts = F.least(F.lit(HOT_PARTS), F.ceil(F.col(n) / bar).cast("int") + 1)
    return counts.where(F.col(n) > bar).select(*keys, salts.alias(_N))


def hot_keys(df: DataFrame, keys: list[str], total: int | None = None) -> DataFrame:
    """Hot keys of ``df``; the count is combined before its shuffle."""
    counts = df.where(_all_set(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if total is not None:
        return hot_from_counts(counts, keys, "__n", total)
    bar = counts.agg(F.greatest(F.lit(HOT_ROWS), F.floor(F.sum("__n") / HOT_PARTS)).alias("__bar"))
    many = counts.where(F.col("__n") > HOT_ROWS).join(F.broadcast(bar)).where(F.col("__n") > F.col("__bar"))  # one row
    return many.select(*keys, F.least(F.lit(HOT_PARTS), F.ceil(F.col("__n") / F.col("__bar")).cast("int") + 1).alias(_N))


def _all_set(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", *, total: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join of ``big`` with ``small`` on ``keys``, split where a key is hot in ``big``.

    Rows of a hot key get one of several salts (from a hash of the whole row, so
    that a recomputed task salts alike); the rows of ``small`` with that key are
    repeated once per salt.  Null keys are spread too, since an outer or anti join
    would otherwise send them all to one task.  ``how``: inner, left, left_semi or
    left_anti.  ``total`` is the number of rows of ``big``, which is counted in the
    plan itself where it isn't given.  If no key can be hot, the plain join comes out.
    """
    if total is not None and total <= HOT_ROWS:
        return big.join(small, keys, how)
    if hot is None:
        hot = hot_keys(big, keys, total)
    hashed = F.xxhash64(*[F.col(c) for c in big.columns])
    left = big.join(F.broadcast(hot), keys, "left")
    n = F.when(_all_set(keys), F.coalesce(F.col(_N), F.lit(1))).otherwise(F.lit(HOT_PARTS))
    left = left.withColumn(SALT, F.pmod(hashed, n).cast("int")).drop(_N)
    right = small.join(F.broadcast(hot), keys, "left")
    right = right.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_N), F.lit(1)) - 1))).drop(_N)
    return left.join(right, [*keys, SALT], how).drop(SALT)
