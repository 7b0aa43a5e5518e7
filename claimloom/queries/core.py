"""Queries of the general training-data problems (3 and 7), with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.operators import hierarchy, orphans
from claimloom.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.roots_and_depths(table(spark, d, "cc_edges"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(table(spark, d, "cc_edges"), with_path=True)
    return h.selectExpr("node_id", "root_id", "tree_depth", "height", "subtree_size", "array_join(path, '/') as path")


def p3_other_parents(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.other_parents(table(spark, d, "cc_edges"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(table(spark, d, "cc_edges"), with_path=True)
    return hierarchy.descendants(h)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_references(table(spark, d, "cc_edges"), table(spark, d, "cc_nodes"), table(spark, d, "cc_deleted"))
    return found.select("src", "tgt", "relation", "side", "orphan_kind")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    nodes, deleted = table(spark, d, "cc_nodes"), table(spark, d, "cc_deleted")
    edges = orphans.orphan_references(table(spark, d, "cc_edges"), nodes, deleted)
    decisions = orphans.orphan_decisions(table(spark, d, "merge_decisions"), nodes, deleted)
    return orphans.orphan_report(cc_edges=edges, merge_decisions=decisions)


QUERIES: dict[str, Query] = {q.__name__: q for q in (p3_found, p3_hierarchy, p3_descendants, p3_other_parents, p7_found, p7_report)}

_BLANK = r"'^[\s\p{Z}]*$'"
_LINKS = rf"""
hier AS (
  SELECT regexp_replace(lower(relation), '[^\p{{L}}]+', '', 'g') AS r, src, tgt FROM cc_edges
  WHERE src IS NOT NULL AND tgt IS NOT NULL AND NOT regexp_matches(src, {_BLANK}) AND NOT regexp_matches(tgt, {_BLANK})),
pairs AS (
  SELECT tgt AS node, src AS parent FROM hier WHERE r = 'decomposesinto'
  UNION SELECT src, tgt FROM hier WHERE r = 'aggregatesto'
  UNION SELECT src, NULL FROM hier WHERE r = 'decomposesinto'
  UNION SELECT tgt, NULL FROM hier WHERE r = 'aggregatesto'),
links AS (SELECT node, min(parent) AS parent FROM pairs GROUP BY node),
walk AS (
  SELECT node, node AS at, [node] AS up, false AS ring FROM links
  UNION ALL
  SELECT w.node, l.parent, list_append(w.up, l.parent), list_contains(w.up, l.parent)
  FROM walk w JOIN links l ON l.node = w.at WHERE l.parent IS NOT NULL AND NOT w.ring),
ends AS (SELECT node, arg_max(up, len(up)) AS up, bool_or(ring) AS ring FROM walk GROUP BY node),
tops AS (
  SELECT node, up, ring, CASE WHEN ring THEN list_min(up[list_position(up, up[-1]):]) ELSE up[-1] END AS root_id,
         ring AND list_contains(up[2:], node) AS on_ring FROM ends)"""
_REFS = rf"""
keys AS (SELECT src, tgt, relation, min(created_at) AS created_at FROM cc_edges GROUP BY ALL),
refs AS (
  SELECT *, 'src' AS side, src AS id FROM keys UNION ALL SELECT *, 'tgt' AS side, tgt AS id FROM keys),
born AS (SELECT node_id, min(created_at) AS born FROM cc_nodes WHERE node_id IS NOT NULL GROUP BY node_id),
gone AS (SELECT DISTINCT node_id FROM cc_deleted),
found AS (
  SELECT r.src, r.tgt, r.relation, r.side, r.created_at,
         CASE WHEN b.node_id IS NOT NULL AND b.born > r.created_at THEN 'late'
              WHEN b.node_id IS NOT NULL THEN NULL
              WHEN g.node_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind
  FROM refs r LEFT JOIN born b ON b.node_id = r.id LEFT JOIN gone g ON g.node_id = r.id
  WHERE r.id IS NOT NULL AND NOT regexp_matches(r.id, {_BLANK}))"""

SQL: dict[str, str] = {
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT node AS node_id, root_id, CAST(CASE WHEN ring THEN -1 ELSE len(up) - 1 END AS INTEGER) AS tree_depth FROM tops",
    "p3_hierarchy": f"""WITH RECURSIVE {_LINKS},
      below AS (SELECT unnest(up) AS anc, node, generate_subscripts(up, 1) - 1 AS steps FROM ends WHERE NOT ring),
      rung AS (SELECT t.node, min(t.i) AS p FROM (SELECT node, unnest(up) AS anc, generate_subscripts(up, 1) AS i FROM tops WHERE ring) t JOIN (SELECT node AS rn FROM tops WHERE on_ring) r ON r.rn = t.anc GROUP BY t.node),
      ringed AS (SELECT t.node, CASE WHEN t.on_ring THEN NULL ELSE list_reverse(t.up[1:r.p]) END AS path FROM tops t JOIN rung r ON r.node = t.node),
      rows AS (SELECT t.node, t.root_id, t.ring, t.on_ring, CASE WHEN t.ring THEN r.path ELSE list_reverse(t.up) END AS path FROM tops t LEFT JOIN ringed r ON r.node = t.node),
      sizes AS (SELECT anc, count(*) AS subtree_size, max(steps) AS height FROM (
        SELECT unnest(path) AS anc, len(path) - generate_subscripts(path, 1) AS steps FROM rows WHERE path IS NOT NULL) GROUP BY anc)
      SELECT w.node AS node_id, w.root_id, CAST(CASE WHEN w.ring THEN -1 ELSE len(w.path) - 1 END AS INTEGER) AS tree_depth,
        CAST(CASE WHEN w.on_ring THEN NULL ELSE s.height END AS INTEGER) AS height, CAST(CASE WHEN w.on_ring THEN NULL ELSE s.subtree_size END AS BIGINT) AS subtree_size, array_to_string(w.path, '/') AS path
      FROM rows w LEFT JOIN sizes s ON s.anc = w.node""",
    "p3_descendants": f"""WITH RECURSIVE {_LINKS},
      ring AS (SELECT node FROM tops WHERE on_ring),
      above AS (SELECT unnest(up) AS anc, node, generate_subscripts(up, 1) - 1 AS steps FROM tops WHERE NOT on_ring),
      stop AS (SELECT a.node, min(a.steps) AS last FROM above a JOIN ring r ON r.node = a.anc GROUP BY a.node)
      SELECT a.anc AS ancestor, a.node AS node_id, CAST(a.steps AS INTEGER) AS steps FROM above a LEFT JOIN stop s ON s.node = a.node WHERE a.steps > 0 AND a.steps <= coalesce(s.last, a.steps)""",
    "p3_other_parents": f"""WITH RECURSIVE {_LINKS}
      SELECT p.node AS node_id, p.parent AS parent_id, l.parent AS kept_parent FROM pairs p JOIN links l ON l.node = p.node WHERE p.parent <> l.parent""",
    "p7_found": f"WITH {_REFS} SELECT src, tgt, relation, side, orphan_kind FROM found WHERE orphan_kind IS NOT NULL",
    "p7_report": f"""WITH {_REFS},
      dec AS (SELECT DISTINCT decision_id, decided_at, unnest(list_concat([{{'side': 'canonical_id', 'id': canonical_id}}, {{'side': 'parent_id', 'id': parent_id}}], list_transform(coalesce(dup_ids, []), lambda x: {{'side': 'dup_ids', 'id': x}}))) AS r FROM merge_decisions),
      one AS (SELECT decision_id, r.side AS side, r.id AS id, min(decided_at) AS created_at FROM dec WHERE r.id IS NOT NULL AND NOT regexp_matches(r.id, {_BLANK}) GROUP BY ALL),
      both_ AS (SELECT 'cc_edges' AS table_name, side, orphan_kind, created_at FROM found UNION ALL
        SELECT 'merge_decisions', o.side, CASE WHEN b.node_id IS NOT NULL AND b.born > o.created_at THEN 'late' WHEN b.node_id IS NOT NULL THEN NULL WHEN g.node_id IS NOT NULL THEN 'deleted' ELSE 'missing' END, o.created_at
        FROM one o LEFT JOIN born b ON b.node_id = o.id LEFT JOIN gone g ON g.node_id = o.id)
      SELECT table_name, side, orphan_kind, coalesce(strftime(created_at, '%Y-%m'), 'unknown') AS month, count(*) AS n_references FROM both_ WHERE orphan_kind IS NOT NULL GROUP BY ALL""",
}
