"""Text cut off by field limits (problem 4): word trigrams inside texts versus at their ends, in SQL.

Every text is read as words, numbers (all alike), capitalised words (all alike, the
first of a text apart) and marks.  For each trigram it is counted how often a text
goes on after it and how often one ends with it.  A text whose final trigram is
frequent inside, but almost never an end, was cut.  A last word may itself be cut, so
inside occurrences count if they begin with it.  Where a trigram is rare, its last
two words and its last word stand in for it, in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import has_value
from claimloom.plans.lineage import cut
from claimloom.plans.skew import salted_join

#: A final trigram with less than this share of ends among its occurrences marks a cut.
END_SHARE = 0.05
#: Weight, in occurrences, of the shorter context that stands in for a rare one.
BACKOFF = 4.0

# The fields of provenance that hold text.
TEXT_KEYS = ["raw_citation", "code_span"]

# Trailing marks of a cut that say nothing about the words before them: white space, ellipses, broken characters.
_TAIL = r"(?:\\s|…|\\.\\.\\.|�)+$"
# Words (with inner apostrophes and hyphens), numbers (with inner marks), single marks; nothing is tried twice.
_TOKEN = r"[a-zA-Z]++(?:[\\x27’_-]?[\\p{L}\\p{M}\\p{N}]++)*+[_-]?|[0-9]++(?:[.,:/]?[\\p{L}\\p{N}_-]++)*+|[\\p{L}\\p{M}\\p{N}]++(?:[\\x27’_-]?[\\p{L}\\p{M}\\p{N}]++)*+[_-]?|[^\\s\\p{L}\\p{M}\\p{N}]"

# One string per text: its tokens with a space between, after two marks of the beginning.
_WORDS = """
SELECT id, field_name, kind, array_join(transform(regexp_extract_all(IF(right(text, 1) RLIKE '[\\\\s….�]', regexp_replace(text, '<tail>', ''), text), '<token>', 0),
    (t, i) -> CASE WHEN lower(t) = t THEN IF(translate(t, '0123456789', '') = t, t, '0') ELSE IF(i = 0, '^A', 'A') END), ' ') AS w
FROM {texts}"""
for _k, _v in (("tail", _TAIL), ("token", _TOKEN)):
    _WORDS = _WORDS.replace(f"<{_k}>", _v.replace("{", "{{").replace("}", "}}"))

_TRIGRAMS = """
SELECT kind, g.a, g.b, g.c, count_if(NOT g.e) AS inside, count_if(g.e) AS ends
FROM (SELECT kind, split(concat('^ ^ ', w), ' ') AS w FROM {words} WHERE w <> '')
LATERAL VIEW explode(transform(sequence(3, size(w)), i -> named_struct('a', w[i - 3], 'b', w[i - 2], 'c', w[i - 1], 'e', i = size(w)))) x AS g
GROUP BY ALL"""

_SHARES = """
WITH finals AS (SELECT kind, a, b, c, length(c) AS n, ends FROM {trigrams} WHERE ends > 0),
     lens3 AS (SELECT kind, a, b, collect_set(n) AS ns FROM finals GROUP BY ALL),
     lens2 AS (SELECT kind, b, collect_set(n) AS ns FROM finals GROUP BY ALL),
     lens1 AS (SELECT kind, collect_set(n) AS ns FROM finals GROUP BY ALL),
     bi AS (SELECT kind, b, c, sum(inside) AS inside, sum(ends) AS ends FROM {trigrams} GROUP BY ALL),
     uni AS (SELECT kind, c, sum(inside) AS inside, sum(ends) AS ends FROM bi GROUP BY ALL),
     in3 AS (SELECT t.kind, t.a, t.b, substr(t.c, 1, n) AS c, sum(t.inside) AS inside
             FROM {trigrams} t JOIN lens3 l ON t.kind = l.kind AND t.a = l.a AND t.b = l.b LATERAL VIEW explode(l.ns) x AS n
             WHERE n <= length(t.c) AND t.inside > 0 GROUP BY t.kind, t.a, t.b, substr(t.c, 1, n)),
     in2 AS (SELECT t.kind, t.b, substr(t.c, 1, n) AS c, sum(t.inside) AS inside
             FROM bi t JOIN lens2 l ON t.kind = l.kind AND t.b = l.b LATERAL VIEW explode(l.ns) x AS n
             WHERE n <= length(t.c) AND t.inside > 0 GROUP BY t.kind, t.b, substr(t.c, 1, n)),
     in1 AS (SELECT /*+ BROADCAST(l) */ t.kind, substr(t.c, 1, n) AS c, sum(t.inside) AS inside
             FROM uni t JOIN lens1 l ON t.kind = l.kind LATERAL VIEW explode(l.ns) x AS n
             WHERE n <= length(t.c) AND t.inside > 0 GROUP BY t.kind, substr(t.c, 1, n)),
     p1 AS (SELECT u.kind, u.c, u.ends / (u.ends + coalesce(i.inside, 0)) AS p
            FROM uni u LEFT JOIN in1 i ON i.kind = u.kind AND i.c = u.c WHERE u.ends > 0),
     p2 AS (SELECT u.kind, u.b, u.c, (u.ends + {m} * q.p) / (u.ends + coalesce(i.inside, 0) + {m}) AS p
            FROM bi u JOIN p1 q ON q.kind = u.kind AND q.c = u.c LEFT JOIN in2 i ON i.kind = u.kind AND i.b = u.b AND i.c = u.c WHERE u.ends > 0)
SELECT f.kind, f.a, f.b, f.c, f.ends, coalesce(i.inside, 0) AS inside, (f.ends - 1 + {m} * q.p) / (f.ends - 1 + coalesce(i.inside, 0) + {m}) AS p
FROM finals f JOIN p2 q ON q.kind = f.kind AND q.b = f.b AND q.c = f.c
LEFT JOIN in3 i ON i.kind = f.kind AND i.a = f.a AND i.b = f.b AND i.c = f.c"""


def field_texts(nodes: DataFrame) -> DataFrame:
    """(id, field_name, kind, text): the texts of context and provenance, id being node_id and version.

    A provenance gives its whole string, counted apart from running text (kind), and
    each text value inside, be it JSON or another notation of the same fields.
    """
    inside = []
    for key in TEXT_KEYS:
        quoted = rf"['\"]{key}['\"]\s*:\s*(?:\"((?:[^\"\\]++|\\.)*+)\"|'((?:[^'\\]++|\\.)*+)')\s*[,}}]"
        one, two = F.regexp_extract("provenance", quoted, 1), F.regexp_extract("provenance", quoted, 2)
        inside.append(F.struct(F.lit("provenance").alias("field_name"), F.lit("text").alias("kind"), F.when(F.length(one) > 0, one).otherwise(two).alias("text")))
    whole = [F.struct(F.lit(f).alias("field_name"), F.lit(k).alias("kind"), F.col(f).alias("text")) for f, k in (("context", "text"), ("provenance", "provenance"))]
    rows = nodes.where(F.col("node_id").isNotNull()).select("node_id", "version", "context", "provenance").distinct()
    each = rows.select(F.struct("node_id", "version").alias("id"), F.explode(F.array(*whole, *inside)).alias("x")).select("id", "x.*")
    return each.where(has_value(F.col("text")))


def end_shares(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words of each text (written once), and for every final trigram its share of ends."""
    spark = texts.sparkSession
    words = cut(spark.sql(_WORDS, texts=texts))
    trigrams = cut(spark.sql(_TRIGRAMS, words=words))
    return words, spark.sql(_SHARES.replace("{m}", str(BACKOFF)), trigrams=trigrams)


def truncated(nodes: DataFrame, end_share: float = END_SHARE) -> DataFrame:
    """(node_id, version, field_name): values of context and provenance that were cut.

    A value is reported if it, or for provenance a text value inside, ends with a
    trigram that is almost never an end.  Null, blank and stand-in values are no
    cases; a text cut just after a complete sentence can't be told from a whole one.
    Counts are over all rows; repeated rows count once, as do repeated keys in the
    result.  Texts are read whole, whatever their length; empty input gives no rows.
    """
    texts = field_texts(nodes)
    words, shares = end_shares(texts)
    flagged = shares.where(F.col("p") < end_share).select("kind", F.concat_ws(" ", "a", "b", "c").alias("last"))
    last = words.where(F.col("w") != "").select("id", "field_name", "kind", F.substring_index(F.concat(F.lit("^ ^ "), "w"), " ", -3).alias("last"))
    hit = salted_join(last, flagged, ["kind", "last"], "left_semi", total=words.count())
    return hit.select("id.node_id", "id.version", "field_name").distinct()


def truncation_by_source(nodes: DataFrame, cut_values: DataFrame) -> DataFrame:
    """Values and cut values of each field per collection (the first part of source_pdf; ``unknown`` if it has no value)."""
    named = F.when(has_value(F.col("source_pdf")), F.split("source_pdf", "/")[0]).otherwise(F.lit("unknown"))
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), has_value(F.col(f)).alias("ok")) for f in ("context", "provenance")]))
    rows = nodes.where(F.col("node_id").isNotNull()).groupBy("node_id", "version").agg(F.min(named).alias("collection"), *[F.max(F.col(f)).alias(f) for f in ("context", "provenance")])
    long = rows.select("node_id", "version", "collection", values.alias("x")).where("x.ok").select("node_id", "version", "collection", "x.field_name")
    marked = long.join(cut_values.withColumn("cut", F.lit(1)), ["node_id", "version", "field_name"], "left")
    per = marked.groupBy("collection", "field_name").agg(F.count(F.lit(1)).alias("n_values"), F.count("cut").alias("n_cut"))
    return per.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_values"), 6))
