"""Queries of the training-data problems tagged llm, with SQL equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import STAND_INS
from claimloom.llm import components, formatdup, knn, leakage, lookalike, survivors, tokenizer, truncation
from claimloom.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = components.groups_of_decisions(table(spark, d, "merge_decisions"))
    return survivors.field_winners(table(spark, d, "cc_nodes"), groups)


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    groups = components.groups_of_decisions(table(spark, d, "merge_decisions"))
    return survivors.survivors(table(spark, d, "cc_nodes"), groups)


def p1_trusted(spark: SparkSession, d: str) -> DataFrame:
    """The same with the most complete record first, then the most trusted, then the latest."""
    groups = components.groups_of_decisions(table(spark, d, "merge_decisions"))
    return survivors.field_winners(table(spark, d, "cc_nodes"), groups, rank=["completeness", "trust", "recency", "version"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.similar_pairs(table(spark, d, "cc_nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "cc_nodes"))


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "cc_nodes")
    return truncation.truncation_by_source(nodes, truncation.truncated(nodes))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.refine(formatdup.records(table(spark, d, "cc_nodes"), table(spark, d, "raw_atoms")))


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.copies_of(p5_found(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.groups_of_decisions(table(spark, d, "merge_decisions"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tokenizer.token_ids(F.col("text")).alias("ids"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p9_longest(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id", "n_words")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leakage.without_leaks(docs, leakage.leaks(docs, table(spark, d, "benchmark"))).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alikes(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_classes(table(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", lookalike.consistent_form(F.col("text")).alias("form"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p1_survivors, p1_trusted, p2_found, p4_found, p4_sources, p5_found, p5_copies, p6_found, p8_ids, p9_found, p9_longest, p9_kept, p10_found, p10_classes, p10_forms)}

_BLANK = r"'^[\s\p{Z}]*$'"
_GROUPS = rf"""
one AS (SELECT canonical_id AS a, unnest(dup_ids) AS b FROM merge_decisions WHERE do_merge),
linked AS (SELECT DISTINCT a, b FROM one WHERE a <> b AND NOT regexp_matches(a, {_BLANK}) AND NOT regexp_matches(b, {_BLANK})),
both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
grouped AS (SELECT a AS member_id, least(a, min(b)) AS group_id FROM reach GROUP BY a)"""
_VALUES = ", ".join(f"'{x}'" for x in STAND_INS)
_WON = rf"""
long AS (
  SELECT g.group_id, n.node_id, n.version, n.updated_at, u.field_name, u.value
  FROM (SELECT node_id, version, updated_at, unnest([{{'field_name': 'context', 'value': context}}, {{'field_name': 'code_ref', 'value': code_ref}}, {{'field_name': 'code_body', 'value': code_body}}, {{'field_name': 'source_pdf', 'value': source_pdf}}]) AS u FROM cc_nodes) n
  JOIN grouped g ON g.member_id = n.node_id
  WHERE u.value IS NOT NULL AND NOT regexp_matches(u.value, {_BLANK}) AND lower(trim(u.value, E' \t\n\r')) NOT IN ({_VALUES})),
won AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY version DESC NULLS LAST, updated_at DESC NULLS LAST, node_id, value DESC) = 1)"""
_HAS = rf"(# IS NOT NULL AND NOT regexp_matches(#, {_BLANK}) AND lower(trim(#, E' \t\n\r')) NOT IN ({_VALUES}))"
_TRUSTED = rf"""
ranked AS (SELECT *, {" + ".join(f"CAST({_HAS.replace('#', f)} AS INTEGER)" for f in survivors.FIELDS)} AS full_, list_position({survivors.TRUST}, lower(status)) AS place FROM cc_nodes WHERE node_id IS NOT NULL),
each_ AS (SELECT g.group_id, n.* FROM ({" UNION ALL ".join(f"SELECT node_id, '{f}' AS field_name, full_, place, updated_at, version FROM ranked WHERE {_HAS.replace('#', f)}" for f in survivors.FIELDS)}) n JOIN grouped g ON g.member_id = n.node_id),
best AS (SELECT * FROM each_ QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY full_ DESC, place NULLS LAST, updated_at DESC NULLS LAST, version DESC NULLS LAST, node_id) = 1)"""
_BARE = "regexp_replace(replace(translate(lower(upper(coalesce({}, ''))), 'ς', 'σ'), 'ß', 'ss'), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"
_FIELD = """CASE WHEN regexp_matches(payload, '^\\s*\\{{') THEN coalesce(payload->>'$.{0}', payload->>'$.{1}', payload->>'$.{2}')
  WHEN regexp_matches(payload, '(?i)(^|\\|)\\s*(name|type|level)\\s*=') THEN regexp_extract(payload, '(?i)(?:^|\\|)\\s*{0}\\s*=\\s*([^|\\n]*)', 1)
  ELSE regexp_extract(payload, '(?im)^[ \\t]*{0}[ \\t]*:[ \\t]*([^\\n]*)', 1) END AS {0}"""
_COPIES = f"""
recs AS (SELECT node_id AS id, name, type, level FROM cc_nodes UNION ALL
  SELECT raw_id, {", ".join(_FIELD.format(f, f.capitalize(), f.upper()) for f in ("name", "type", "level"))} FROM raw_atoms),
bare AS (SELECT DISTINCT id, {", ".join(f"{_BARE.format(f)} AS {f[0]}" for f in ("name", "type", "level"))} FROM recs),
firsts AS (SELECT n, t, l, min(id) AS first_id FROM bare WHERE length(n || t || l) > 0 GROUP BY ALL),
copies AS (SELECT DISTINCT f.first_id, b.id AS copy_id FROM bare b JOIN firsts f USING (n, t, l) WHERE b.id <> f.first_id)"""
_LEAKS = """
w_docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
w_items AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
g_docs AS (SELECT doc_id, i AS p, array_to_string(w[i:i + 12], ' ') AS g FROM w_docs, unnest(generate_series(1, len(w) - 12)) AS s(i)),
g_items AS (SELECT DISTINCT item_id, i AS q, array_to_string(w[i:i + 12], ' ') AS g FROM w_items, unnest(generate_series(1, len(w) - 12)) AS s(i)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM g_docs JOIN g_items USING (g))"""

SQL: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_GROUPS}, {_WON} SELECT group_id, field_name, node_id FROM won",
    "p1_survivors": f"WITH RECURSIVE {_GROUPS}, {_WON} SELECT group_id, {', '.join(f"max(CASE WHEN field_name = '{f}' THEN value END) AS {f}" for f in survivors.FIELDS)} FROM won GROUP BY group_id",
    "p1_trusted": f"WITH RECURSIVE {_GROUPS}, {_TRUSTED} SELECT group_id, field_name, node_id FROM best",
    "p2_found": """WITH u AS (
        SELECT node_id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM cc_nodes
        WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY node_id),
      ranked AS (SELECT a.node_id AS a, b.node_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.node_id <> b.node_id),
      best AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM ranked WHERE c >= 0.9) WHERE n <= 5)
      SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM best""",
    "p5_found": f"WITH {_COPIES} SELECT first_id, copy_id FROM copies",
    "p5_copies": f"WITH {_COPIES} SELECT first_id, count(*) + 1 AS n_copies FROM copies GROUP BY first_id",
    "p6_found": f"WITH RECURSIVE {_GROUPS} SELECT group_id, member_id FROM grouped WHERE group_id <> member_id",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p9_longest": f"""WITH {_LEAKS}, m AS (SELECT doc_id, item_id, p, p - q AS shift FROM g_docs JOIN g_items USING (g)),
      runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS run FROM m)
      SELECT doc_id, item_id, max(n) + 12 AS n_words FROM (SELECT doc_id, item_id, count(*) AS n FROM runs GROUP BY doc_id, item_id, shift, run) GROUP BY doc_id, item_id""",
    "p9_kept": f"WITH {_LEAKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
}
