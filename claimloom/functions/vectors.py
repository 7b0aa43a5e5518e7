"""Vector arithmetic as column expressions over arrays, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of one length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector has length 1, so its cosine is 0."""
    length = F.when(norm(a) == 0, 1.0).otherwise(norm(a)) * F.when(norm(b) == 0, 1.0).otherwise(norm(b))
    return dot(a, b) / length


def finite(a: Column, dim: int) -> Column:
    """True for arrays of ``dim`` finite numbers."""
    return (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once per row however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hash(text: Column, dim: int = 128) -> Column:
    """Offline embedding: words of a-z counted by hash into ``dim`` places, unit length (zeros without words, null for null).

    The place is the first 8 hexadecimal digits of the word's md5, modulo ``dim``.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    places = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dim)))
    none = F.array_repeat(F.lit(0.0), dim)
    add = lambda c, q: F.concat(F.slice(c, 1, q.cast("int")), F.array(F.get(c, q.cast("int")) + 1.0), F.slice(c, q.cast("int") + 2, dim))
    count = lambda p: F.aggregate(p, none, add)
    unit = lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n == 0, c).otherwise(F.transform(c, lambda x: x / n)))
    return F.when(text.isNotNull(), let(places, lambda p: let(count(p), unit)))


def literal_vector(spark: SparkSession, vector: Column) -> Column:
    """The value of a constant vector expression as a literal, so that it isn't worked out per row."""
    return F.array(*[F.lit(float(x)) for x in spark.range(1).select(vector.alias("v")).first()[0]])


def softmax(df: DataFrame, score: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Softmax of ``score``, per ``by``; two aggregations joined back, no single-task window."""
    by = by or []
    if by:
        w = Window.partitionBy(*by)
        shifted = df.withColumn(out, F.exp(F.col(score) - F.max(score).over(w)))
        return shifted.withColumn(out, F.col(out) / F.sum(out).over(w))
    top = df.agg(F.max(score).alias("__top"))
    shifted = df.join(F.broadcast(top)).withColumn(out, F.exp(F.col(score) - F.col("__top"))).drop("__top")  # one row
    total = shifted.agg(F.sum(out).alias("__sum"))
    return shifted.join(F.broadcast(total)).withColumn(out, F.col(out) / F.col("__sum")).drop("__sum")
