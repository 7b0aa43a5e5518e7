"""Queries over the stored graph: scans, mutations, rules, tallies, with SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import ontology as O
from claimloom.functions.text import present
from claimloom.operators import reports, store, validate
from claimloom.plans.lineage import cut
from claimloom.plans.tables import table
from claimloom.schema import LEVEL_SPELLINGS, clean_edges, current_atoms, edge_keys, with_provenance

Query = Callable[[SparkSession, str], DataFrame]


def atoms_(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return current_atoms(table(spark, d, "cc_nodes"), *more)


def edges_(spark: SparkSession, d: str) -> DataFrame:
    return clean_edges(table(spark, d, "cc_edges"))


def scan_level_status(spark, d):
    return store.by_level(atoms_(spark, d), "W4", "solution", "active").select("node_id", "name", "version")


def scan_tag_domain(spark, d):
    return store.by_domain(atoms_(spark, d, "tags"), "marl").select("node_id", "level")


def point_lookup_batch(spark, d):
    ids = table(spark, d, "merge_decisions").select(F.col("canonical_id").alias("node_id"))
    return store.by_ids(atoms_(spark, d), ids).select("node_id", "name", "type", "level")


def vectors_by_level(spark, d):
    v = store.vectors(atoms_(spark, d, "embedding"), "W2")
    return v.select("node_id", F.size("embedding").alias("dim"))


def edge_targets_sources(spark, d):
    ids = table(spark, d, "merge_decisions").where("do_merge").select(F.col("canonical_id").alias("node_id"))
    return store.edge_ends(edge_keys(table(spark, d, "cc_edges")), ids)


def decode_atoms(spark, d):
    a = with_provenance(atoms_(spark, d, "provenance", "tags"))
    return a.select("node_id", "context", "status", "phase", "code_span", "raw_citation", F.round("score", 6).alias("score"), F.coalesce(F.size(F.from_json("tags", "array<string>")), F.lit(0)).alias("n_tags"))


def graph_view_dangling(spark, d):
    return store.graph_view(edges_(spark, d), atoms_(spark, d)).drop("weight")


def consistency_report(spark, d):
    return store.consistency_report(edge_keys(table(spark, d, "cc_edges")), atoms_(spark, d, "embedding"))


def edge_scan_rho(spark, d):
    e = edges_(spark, d)
    rho = F.from_json("rho_json", "bottleneck string, mechanism string, tradeoff string, confidence double")
    has = F.col("rho_json").isNotNull()
    return e.select("src", "tgt", "relation", F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")).alias("weight"), F.when(has, rho["bottleneck"]).alias("bottleneck"), F.when(has, F.coalesce(rho["confidence"], F.lit(0.7))).alias("confidence"))


def migrate_values(spark, d):
    rows = store.migrate(table(spark, d, "cc_nodes").select("node_id", "version", "type", "level"))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_changes").alias("n_changes"))


def store_insert_first_wins(spark, d):
    """Rows of version 1 are the store, all others arrive (those without a version last): an id held already is skipped, of new ids the first row counts."""
    n = table(spark, d, "cc_nodes").where("node_id is not null").select("node_id", "version", "name", "updated_at", "source_pdf")
    held = n.where("version = 1").dropDuplicates(["node_id"])
    new = n.where("version is null or version <> 1")
    return store.insert_blueprint(held, new, [F.col("version").asc_nulls_last(), F.col("updated_at").asc_nulls_last()], "unknown").select("node_id", "version", F.when(F.coalesce("version", F.lit(0)) != 1, F.col("source_pdf")).alias("source_pdf"))


def _upsert_sides(spark, d):
    cols = ["node_id", "name", "type", "level", "context", "version", "tags", "status", "code_body", "source_refs", "provenance", "source_pdf"]
    n = table(spark, d, "cc_nodes").where("node_id is not null").select(*cols).distinct()
    top = n.groupBy("node_id").agg(F.max("version").alias("top"))
    j = n.join(top, "node_id")
    new = store.first_wins(j.where("version = top"), ["node_id"], [F.col("context").asc_nulls_last(), F.col("code_body").asc_nulls_last()]).drop("top")
    old = store.first_wins(j.where("version < top"), ["node_id"], [F.col("version").desc(), F.col("context").asc_nulls_last(), F.col("code_body").asc_nulls_last()]).drop("top")
    return old, new


def store_upsert_coalesce(spark, d):
    old, new = _upsert_sides(spark, d)
    return store.upsert_atoms(old, new).select("node_id", "version", "context", "code_body", "provenance", "source_pdf")


def edges_insert_ignore(spark, d):
    """Edges of 2022 and earlier are the store, later ones and those without a time arrive; what an insert-or-ignore adds."""
    e = table(spark, d, "cc_edges").where(present(F.col("src")) & present(F.col("tgt"))).select("src", "tgt", "relation", "weight", "created_at")
    bar = F.lit("2023-01-01").cast("timestamp_ntz")
    held, new = e.where(F.col("created_at") < bar), e.where(F.col("created_at").isNull() | (F.col("created_at") >= bar))
    return store.insert_ignore(held, new, store.EDGE_KEY, [F.col("created_at").asc_nulls_last(), F.col("weight").asc_nulls_last()]).select("src", "tgt", "relation", "weight")


def delete_touching(spark, d):
    return store.delete_touching(edge_keys(table(spark, d, "cc_edges")), table(spark, d, "cc_deleted"))


def delete_transient(spark, d):
    a, e = store.delete_transient(atoms_(spark, d), edge_keys(table(spark, d, "cc_edges")))
    return a.agg(F.count(F.lit(1)).alias("n_atoms")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("n_edges"))))


def neighbors_both(spark, d):
    ids = table(spark, d, "merge_decisions").where("do_merge").select(F.col("canonical_id").alias("node_id"))
    return store.neighbours(edge_keys(table(spark, d, "cc_edges")), ids)


def status_filter_default(spark, d):
    return reports.tallies(atoms_(spark, d).where(store.status_included(None)), "level", "status")


def validate_r1_atoms(spark, d):
    raw = table(spark, d, "cc_nodes").select("node_id", F.lower("type").alias("type"), "level").distinct()
    return validate.r1_atoms(raw)


def validate_r1_edges(spark, d):
    e = table(spark, d, "cc_edges").where(present(F.col("src")) & present(F.col("tgt"))).select("src", "tgt", "relation").distinct()
    return validate.r1_edges(e, atoms_(spark, d))


def validate_r2(spark, d):
    return validate.r2(edge_keys(table(spark, d, "cc_edges")), atoms_(spark, d))


def validate_r3(spark, d):
    return validate.r3(edges_(spark, d))


def validate_r4(spark, d):
    return validate.r4(edge_keys(table(spark, d, "cc_edges")), atoms_(spark, d))


def validate_r5(spark, d):
    return validate.r5(atoms_(spark, d))


def validate_r6(spark, d):
    return validate.r6(with_provenance(atoms_(spark, d, "provenance")))


def validate_all_counts(spark, d):
    a, e = cut(with_provenance(atoms_(spark, d, "provenance"))), cut(edges_(spark, d))  # read by seven rules
    return reports.tallies(validate.validate(a, e), "rule")


def demote_r6(spark, d):
    return validate.demote(with_provenance(atoms_(spark, d, "provenance"))).where("mutated").select("node_id", "type", "status")


def dedup_merge_rewrite(spark, d):
    a = atoms_(spark, d)
    e = validate.rewrite_ends(edge_keys(table(spark, d, "cc_edges")), validate.merge_map(a))
    return e.groupBy("src", "tgt", "relation").agg(F.count(F.lit(1)).alias("n"))


def apply_fix_actions(spark, d):
    """Accepted decisions as fix actions: canonical atoms take the decided type, edges to a rejected parent go."""
    m = table(spark, d, "merge_decisions")
    act = m.where(F.col("do_merge") & present(F.col("canonical_id"))).select(F.col("decision_id").alias("seq"), F.col("canonical_id").alias("node_id"), F.nullif(F.col("canonical_type"), F.lit("")).alias("type"), F.lit(None).cast("string").alias("level"), F.col("canonical_context").alias("context"))
    return validate.apply_atom_updates(atoms_(spark, d), act.distinct()).select("node_id", "type", "level", "context")


def remove_edge_actions(spark, d):
    m = table(spark, d, "merge_decisions").where(~F.col("do_merge") & present(F.col("parent_id")) & present(F.col("canonical_id")))
    gone = m.select(F.col("parent_id").alias("src"), F.col("canonical_id").alias("tgt"))
    none = m.sparkSession.createDataFrame([], "seq long, src string, tgt string, relation string, rho_json string")
    return validate.apply_edge_actions(edges_(spark, d).select("src", "tgt", "relation", "rho_json"), none, gone).select("src", "tgt", "relation")


def name_validity(spark, d):
    return table(spark, d, "cc_nodes").select("node_id", "version", validate.valid_name(F.col("name")).alias("ok")).distinct()


def _v2(spark, d):
    n = atoms_(spark, d).select(F.col("name"), F.col("type"), F.col("node_id").alias("pos"), "node_id")
    e = edges_(spark, d).where(~F.col("relation").isin(O.HIERARCHY))
    named = n.select("node_id", "name")
    e = e.join(named.select(F.col("node_id").alias("src"), F.col("name").alias("s")), "src").join(named.select(F.col("node_id").alias("tgt"), F.col("name").alias("t")), "tgt", "left")
    e = e.select(F.col("s").alias("src"), F.upper("relation").alias("relation"), F.coalesce("t", "tgt").alias("tgt"), F.col("rho_json").isNotNull().alias("has_rho"))
    return n.drop("node_id"), e


def v2_validate(spark, d):
    return reports.tallies(validate.v2_validate(*_v2(spark, d)), "rule")


def v2_extract_filter(spark, d):
    a, e = validate.v2_filter(*_v2(spark, d))
    return reports.tallies(e, "relation").unionByName(a.agg(F.lit("atoms").alias("relation"), F.count(F.lit(1)).alias("n")))


def v2_tool_coerce(spark, d):
    a, e = validate.v2_coerce(*_v2(spark, d))
    return reports.tallies(a, "type").unionByName(reports.tallies(e, "relation").withColumnRenamed("relation", "type"))


def level_counts_zero_fill(spark, d):
    return reports.level_counts(atoms_(spark, d).where("status = 'transient'"))


def status_counts(spark, d):
    return reports.cards(atoms_(spark, d), "level")


def relation_tallies(spark, d):
    g = store.graph_view(edges_(spark, d), atoms_(spark, d))
    return reports.tallies(g, "relation", "src_level", "tgt_level")


def dedup_rate(spark, d):
    return reports.dedup_rate(atoms_(spark, d))


def union_distinct_ids(spark, d):
    """Set operations over ids: those of atoms, of deletions, of both."""
    a, g = atoms_(spark, d).select("node_id"), table(spark, d, "cc_deleted").select("node_id").distinct()
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(a.union(g).distinct(), "union").unionByName(n(a.intersect(g), "both")).unionByName(n(g.subtract(a), "only_deleted"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        scan_level_status, scan_tag_domain, point_lookup_batch, vectors_by_level, edge_targets_sources, decode_atoms, graph_view_dangling, consistency_report, edge_scan_rho, migrate_values, store_insert_first_wins, store_upsert_coalesce, edges_insert_ignore, delete_touching, delete_transient, neighbors_both, status_filter_default,
        validate_r1_atoms, validate_r1_edges, validate_r2, validate_r3, validate_r4, validate_r5, validate_r6, validate_all_counts, demote_r6, dedup_merge_rewrite, apply_fix_actions, remove_edge_actions, name_validity, v2_validate, v2_extract_filter, v2_tool_coerce, level_counts_zero_fill, status_counts, relation_tallies, dedup_rate, union_distinct_ids,
    )
}

# -- SQL equivalents -----------------------------------------------------------

BLANK = r"'^[\s\p{Z}]*$'"
_map = lambda m: "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in m.items()) + "}"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
LEVEL_SQL = f"coalesce({_map(LEVEL_SPELLINGS)}[regexp_replace(regexp_replace(lower(level), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '[\\s_-]+', '_', 'g')], level)"
TYPE_SQL = f"coalesce({_map(O.TYPE_MIGRATIONS)}[regexp_replace(lower(type), '[^a-z]+', '', 'g')], regexp_replace(lower(type), '[^a-z]+', '', 'g'))"
CUR = f"""cur AS (
  SELECT * REPLACE ({TYPE_SQL} AS type, {LEVEL_SQL} AS level, coalesce(context, '') AS context, coalesce(lower(status), 'active') AS status)
  FROM (SELECT * FROM cc_nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY version DESC NULLS LAST, updated_at DESC NULLS LAST) = 1))"""
PROV = """prov AS (
  SELECT * REPLACE (CASE WHEN json_valid(provenance) AND provenance <> '{}' THEN provenance END AS provenance),
    CASE WHEN json_valid(provenance) THEN provenance->>'$.raw_citation' END AS raw_citation, CASE WHEN json_valid(provenance) THEN provenance->>'$.code_span' END AS code_span,
    CASE WHEN json_valid(provenance) THEN provenance->>'$.phase' END AS phase,
    TRY_CAST(CASE WHEN json_valid(provenance) THEN provenance->>'$.score' END AS DOUBLE) AS score, TRY_CAST(CASE WHEN json_valid(provenance) THEN provenance->>'$.score_std' END AS DOUBLE) AS score_std
  FROM cur)"""
OKE = f"src IS NOT NULL AND tgt IS NOT NULL AND NOT regexp_matches(src, {BLANK}) AND NOT regexp_matches(tgt, {BLANK})"
REL_SQL = r"regexp_replace(regexp_replace(lower(relation), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s_-]+', '_', 'g')"
EDG = f"""edg AS (
  SELECT src, tgt, relation, weight, rho_json, provenance, created_at FROM (SELECT * REPLACE ({REL_SQL} AS relation) FROM cc_edges WHERE {OKE})
  QUALIFY row_number() OVER (PARTITION BY src, tgt, relation ORDER BY created_at NULLS LAST, weight NULLS LAST, rho_json NULLS LAST, provenance NULLS LAST) = 1)"""
KEY = f"ek AS (SELECT DISTINCT src, tgt, {REL_SQL} AS relation FROM cc_edges WHERE {OKE})"
MATRIX_SQL = "mat(relation, s, t) AS (VALUES " + ", ".join(f"('{r}', '{a}', '{b}')" for r, ps in O.MATRIX.items() for a, b in ps) + ")"
ORD = "(list_position([" + ", ".join(f"'{x}'" for x in O.LEVELS) + "], {}) - 1)"
NEED = f"{_map(O.REQUIRED_PROVENANCE)}[type]"
MISS = f"({NEED} IS NOT NULL AND NOT CASE {NEED} WHEN 'score' THEN score IS NOT NULL WHEN 'raw_citation' THEN raw_citation IS NOT NULL ELSE provenance IS NOT NULL END)"
R5 = """r5 AS (
  SELECT a.node_id AS target, f.first_id FROM cur a JOIN (
    SELECT lower(name) AS k, type, level, arg_min(node_id, (coalesce(created_at, TIMESTAMP '9999-12-31'), node_id)) AS first_id FROM cur GROUP BY ALL HAVING count(*) > 1) f
  ON lower(a.name) = f.k AND a.type = f.type AND a.level = f.level WHERE a.node_id <> f.first_id)"""
HELD = "held AS (SELECT e.*, s.node_id AS has_src, s.type AS src_type, s.level AS src_level, t.node_id AS has_tgt, t.type AS tgt_type, t.level AS tgt_level FROM {} e LEFT JOIN cur s ON s.node_id = e.src LEFT JOIN cur t ON t.node_id = e.tgt)"
ER = "src || '->' || tgt"
_R2 = f"SELECT 'R2' AS rule, {ER} AS target, relation || ' ' || src_type || '>' || tgt_type AS message FROM held h WHERE has_src IS NOT NULL AND has_tgt IS NOT NULL AND relation IN {_in(O.MATRIX)} AND NOT EXISTS (SELECT 1 FROM mat WHERE mat.relation = h.relation AND s = src_type AND t = tgt_type)"
_R3 = f"SELECT 'R3' AS rule, {ER} AS target, 'no evidence for ' || relation AS message FROM {{}} WHERE relation IN {_in(O.STRONG_CAUSAL)} AND rho_json IS NULL"
_R4 = f"SELECT 'R4' AS rule, {ER} AS target, relation || ' ' || src_level || '>' || tgt_level AS message FROM held WHERE has_src IS NOT NULL AND has_tgt IS NOT NULL AND CASE relation WHEN 'aggregates_to' THEN {ORD.format('tgt_level')} >= {ORD.format('src_level')} WHEN 'decomposes_into' THEN {ORD.format('tgt_level')} <= {ORD.format('src_level')} END"
_R1E = f"""SELECT 'R1' AS rule, {ER} AS target, unnest(list_filter([
  CASE WHEN coalesce(relation, '') NOT IN {_in(O.HORIZONTAL + O.HIERARCHY)} THEN 'unknown relation ' || coalesce(relation, '') END,
  CASE WHEN has_src IS NULL THEN 'missing source ' || src END, CASE WHEN has_tgt IS NULL THEN 'missing target ' || tgt END], lambda m: m IS NOT NULL)) AS message FROM held"""
_R1A = f"""SELECT 'R1' AS rule, coalesce(node_id, '') AS target, unnest(list_filter([
  CASE WHEN coalesce(node_id, '') = '' THEN 'empty id' END, CASE WHEN coalesce(type, '') NOT IN {_in(O.TYPES)} THEN 'unknown type ' || coalesce(type, '') END,
  CASE WHEN coalesce(level, '') NOT IN {_in(O.LEVELS)} THEN 'unknown level ' || coalesce(level, '') END], lambda m: m IS NOT NULL)) AS message FROM {{}}"""
_R6 = f"SELECT 'R6' AS rule, node_id AS target, 'provenance needed for ' || type AS message FROM prov WHERE type IN {_in(O.TYPES)} AND level IN {_in(O.LEVELS)} AND {MISS}"
_CANON = "ids AS (SELECT DISTINCT canonical_id AS node_id FROM merge_decisions WHERE do_merge)"
_ENDS = f"SELECT i.node_id, tgt AS other, relation, 'out' AS direction FROM ek JOIN ids i ON i.node_id = src UNION ALL SELECT i.node_id, src, relation, 'in' FROM ek JOIN ids i ON i.node_id = tgt"
_V2 = f"""v2a AS (SELECT name, type, node_id AS pos FROM cur),
v2e AS (SELECT s.name AS src, upper(e.relation) AS relation, coalesce(t.name, e.tgt) AS tgt, e.rho_json IS NOT NULL AS has_rho FROM edg e JOIN cur s ON s.node_id = e.src LEFT JOIN cur t ON t.node_id = e.tgt WHERE e.relation NOT IN {_in(O.HIERARCHY)})"""
_VALID = "coalesce(length({0}) >= 2 AND NOT regexp_matches({0}, '^\\p{{Nd}}+$') AND regexp_matches({0}, '[A-Za-z0-9]'), false)"
_V2MAT = "m2(relation, s, t) AS (VALUES " + ", ".join(f"('{r}', '{a}', '{b}')" for r, ps in validate.V2_MATRIX.items() for a, b in ps) + ")"
_UPS = "node_id, name, type, level, context, version, tags, status, code_body, source_refs, provenance, source_pdf"

SQL: dict[str, str] = {
    "scan_level_status": f"WITH {CUR} SELECT node_id, name, version FROM cur WHERE level = 'W4_implementation' AND type = 'solution' AND status = 'active'",
    "scan_tag_domain": f"""WITH {CUR} SELECT node_id, level FROM cur WHERE list_contains(CAST(json_extract_string(tags, '$[*]') AS VARCHAR[]), 'domain:marl')""",
    "point_lookup_batch": f"WITH {CUR} SELECT node_id, name, type, level FROM cur WHERE node_id IN (SELECT canonical_id FROM merge_decisions)",
    "vectors_by_level": f"WITH {CUR} SELECT node_id, len(embedding)::INT AS dim FROM cur WHERE level = 'W2_direction' AND len(embedding) > 0",
    "edge_targets_sources": f"WITH {KEY}, {_CANON} {_ENDS}",
    "decode_atoms": f"WITH {CUR}, {PROV} SELECT node_id, context, status, phase, code_span, raw_citation, round(score, 6) AS score, coalesce(json_array_length(tags), 0)::INT AS n_tags FROM prov",
    "graph_view_dangling": f"WITH {CUR}, {EDG} SELECT src, tgt, relation, s.type AS src_type, s.level AS src_level, t.type AS tgt_type, t.level AS tgt_level FROM edg JOIN cur s ON s.node_id = src JOIN cur t ON t.node_id = tgt",
    "consistency_report": f"WITH {CUR}, {KEY} SELECT (SELECT count(*) FROM cur) AS n_atoms, (SELECT count(*) FROM ek) AS n_edges, (SELECT count(*) FROM ek WHERE src NOT IN (SELECT node_id FROM cur) OR tgt NOT IN (SELECT node_id FROM cur)) AS n_dangling, (SELECT count(*) FROM cur WHERE len(embedding) > 0) AS n_vectors",
    "edge_scan_rho": f"WITH {EDG} SELECT src, tgt, relation, CASE WHEN coalesce(weight, 0) = 0 THEN 1.0 ELSE weight END AS weight, rho_json->>'$.bottleneck' AS bottleneck, CASE WHEN rho_json IS NOT NULL THEN coalesce(CAST(rho_json->>'$.confidence' AS DOUBLE), 0.7) END AS confidence FROM edg",
    "migrate_values": f"""SELECT coalesce({_map(O.LEVEL_MIGRATIONS)}[level], level) AS level, count(*) AS n_rows,
      CAST(sum(CAST({_map(O.LEVEL_MIGRATIONS)}[level] IS NOT NULL AS INT) + CAST({_map(O.TYPE_MIGRATIONS)}[type] IS NOT NULL AS INT)) AS BIGINT) AS n_changes FROM cc_nodes GROUP BY 1""",
    "store_insert_first_wins": """WITH n AS (SELECT * FROM cc_nodes WHERE node_id IS NOT NULL), h AS (SELECT DISTINCT node_id FROM n WHERE version = 1),
      new AS (SELECT * FROM n WHERE version IS DISTINCT FROM 1 AND node_id NOT IN (SELECT node_id FROM h) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY version NULLS LAST, updated_at NULLS LAST) = 1)
      SELECT node_id, 1 AS version, NULL AS source_pdf FROM h UNION ALL SELECT node_id, version, coalesce(source_pdf, 'unknown') FROM new""",
    "store_upsert_coalesce": f"""WITH n AS (SELECT DISTINCT {_UPS}, max(version) OVER (PARTITION BY node_id) AS top FROM cc_nodes WHERE node_id IS NOT NULL),
      new AS (SELECT * FROM n WHERE version = top QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY context NULLS LAST, code_body NULLS LAST) = 1),
      old AS (SELECT * FROM n WHERE version < top QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY version DESC, context NULLS LAST, code_body NULLS LAST) = 1)
      SELECT coalesce(o.node_id, n.node_id) AS node_id, CASE WHEN n.node_id IS NOT NULL THEN n.version ELSE o.version END AS version, CASE WHEN n.node_id IS NOT NULL THEN n.context ELSE o.context END AS context,
        coalesce(n.code_body, o.code_body) AS code_body, coalesce(n.provenance, o.provenance) AS provenance, CASE WHEN o.node_id IS NULL THEN n.source_pdf ELSE o.source_pdf END AS source_pdf
      FROM old o FULL JOIN new n ON n.node_id = o.node_id""",
    "edges_insert_ignore": f"""WITH e AS (SELECT * FROM cc_edges WHERE {OKE}), h AS (SELECT * FROM e WHERE created_at < TIMESTAMP '2023-01-01'),
      n AS (SELECT * FROM e WHERE created_at IS NULL OR created_at >= TIMESTAMP '2023-01-01' QUALIFY row_number() OVER (PARTITION BY src, tgt, relation ORDER BY created_at NULLS LAST, weight NULLS LAST) = 1)
      SELECT src, tgt, relation, weight FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.src = n.src AND h.tgt = n.tgt AND h.relation = n.relation)""",
    "delete_touching": f"WITH {KEY}, g AS (SELECT node_id FROM cc_deleted WHERE node_id IS NOT NULL) SELECT * FROM ek WHERE src NOT IN (SELECT node_id FROM g) AND tgt NOT IN (SELECT node_id FROM g)",
    "delete_transient": f"WITH {CUR}, {KEY}, g AS (SELECT node_id FROM cur WHERE status = 'transient') SELECT (SELECT count(*) FROM cur WHERE status <> 'transient') AS n_atoms, (SELECT count(*) FROM ek WHERE src NOT IN (SELECT node_id FROM g) AND tgt NOT IN (SELECT node_id FROM g)) AS n_edges",
    "neighbors_both": f"WITH {KEY}, {_CANON} SELECT DISTINCT node_id, other AS neighbour FROM ({_ENDS})",
    "status_filter_default": f"WITH {CUR} SELECT level, status, count(*) AS n FROM cur WHERE status IN {_in(O.TRUSTED_STATUSES)} GROUP BY ALL",
    "validate_r1_atoms": f"WITH raw AS (SELECT DISTINCT node_id, lower(type) AS type, level FROM cc_nodes) {_R1A.format('raw')}",
    "validate_r1_edges": f"WITH {CUR}, raw AS (SELECT DISTINCT src, tgt, relation FROM cc_edges WHERE {OKE}), {HELD.format('raw')} {_R1E}",
    "validate_r2": f"WITH {CUR}, {KEY}, {MATRIX_SQL}, {HELD.format('ek')} {_R2}",
    "validate_r3": f"WITH {EDG} {_R3.format('edg')}",
    "validate_r4": f"WITH {CUR}, {KEY}, {HELD.format('ek')} {_R4}",
    "validate_r5": f"WITH {CUR}, {R5} SELECT 'R5' AS rule, target, 'duplicate of ' || first_id AS message FROM r5",
    "validate_r6": f"WITH {CUR}, {PROV} {_R6}",
    "validate_all_counts": f"WITH {CUR}, {PROV}, {EDG}, {MATRIX_SQL}, {R5}, {HELD.format('edg')} SELECT rule, count(*) AS n FROM ({_R1A.format('cur')} UNION ALL {_R6} UNION ALL {_R1E} UNION ALL {_R3.format('edg')} UNION ALL {_R2} UNION ALL {_R4} UNION ALL SELECT 'R5', target, first_id FROM r5) GROUP BY rule",
    "demote_r6": f"WITH {CUR}, {PROV} SELECT node_id, coalesce({_map(O.DEMOTIONS)}[type], type) AS type, CASE WHEN {_map(O.DEMOTIONS)}[type] IS NOT NULL THEN 'demoted' ELSE 'needs_review' END AS status FROM prov WHERE {MISS}",
    "dedup_merge_rewrite": f"WITH {CUR}, {KEY}, {R5} SELECT coalesce(s.first_id, src) AS src, coalesce(t.first_id, tgt) AS tgt, relation, count(*) AS n FROM ek LEFT JOIN r5 s ON s.target = src LEFT JOIN r5 t ON t.target = tgt GROUP BY ALL",
    "apply_fix_actions": f"""WITH {CUR}, a AS (SELECT DISTINCT decision_id AS seq, canonical_id AS node_id, nullif(canonical_type, '') AS type, canonical_context AS context FROM merge_decisions WHERE do_merge AND NOT regexp_matches(canonical_id, {BLANK})),
      l AS (SELECT node_id, arg_max(type, seq) FILTER (type IS NOT NULL) AS type, arg_max(context, seq) FILTER (context IS NOT NULL) AS context FROM a GROUP BY 1)
      SELECT c.node_id, coalesce(l.type, c.type) AS type, c.level, coalesce(l.context, c.context) AS context FROM cur c LEFT JOIN l ON l.node_id = c.node_id""",
    "remove_edge_actions": f"WITH {EDG} SELECT src, tgt, relation FROM edg WHERE NOT EXISTS (SELECT 1 FROM merge_decisions WHERE NOT do_merge AND parent_id = src AND canonical_id = tgt AND NOT regexp_matches(parent_id, {BLANK}))",
    "name_validity": f"SELECT DISTINCT node_id, version, {_VALID.format('name')} AS ok FROM cc_nodes",
    "v2_validate": f"""WITH {CUR}, {EDG}, {_V2}, {_V2MAT}, nm AS (SELECT name, arg_max(type, pos) AS type FROM v2a WHERE name IS NOT NULL GROUP BY name),
      h AS (SELECT e.*, s.type AS st, t.type AS tt FROM v2e e LEFT JOIN nm s ON s.name = e.src LEFT JOIN nm t ON t.name = e.tgt)
      SELECT rule, count(*) AS n FROM (SELECT 'name' AS rule FROM v2a WHERE NOT {_VALID.format('name')} UNION ALL SELECT 'type' FROM v2a WHERE type NOT IN {_in(validate.V2_TYPES)}
        UNION ALL SELECT 'endpoint' FROM h WHERE st IS NULL UNION ALL SELECT 'endpoint' FROM h WHERE tt IS NULL UNION ALL SELECT 'evidence' FROM h WHERE relation IN {_in(validate.V2_STRONG)} AND NOT has_rho
        UNION ALL SELECT 'pair' FROM h WHERE st IS NOT NULL AND tt IS NOT NULL AND relation IN {_in(validate.V2_MATRIX)} AND NOT EXISTS (SELECT 1 FROM m2 WHERE m2.relation = h.relation AND s = st AND t = tt)) GROUP BY rule""",
    "v2_extract_filter": f"""WITH {CUR}, {EDG}, {_V2}, k AS (SELECT * FROM v2a WHERE {_VALID.format('name')} AND type IN {_in(validate.V2_TYPES)})
      SELECT relation, count(*) AS n FROM v2e WHERE (relation NOT IN {_in(validate.V2_STRONG)} OR has_rho) AND src IN (SELECT name FROM k) AND tgt IN (SELECT name FROM k) GROUP BY relation UNION ALL SELECT 'atoms', count(*) FROM k""",
    "v2_tool_coerce": f"WITH {CUR}, {EDG}, {_V2} SELECT CASE WHEN lower(type) IN {_in(validate.V2_TYPES)} THEN lower(type) ELSE 'method' END AS type, count(*) AS n FROM v2a GROUP BY 1 UNION ALL SELECT relation, count(*) FROM v2e WHERE relation IN {_in(validate.V2_RELATIONS)} GROUP BY 1",
    "level_counts_zero_fill": f"WITH {CUR}, l(level) AS (VALUES {', '.join(f"('{x}')" for x in O.LEVELS)}) SELECT l.level, count(node_id) AS n FROM l LEFT JOIN cur c ON c.level = l.level AND c.status = 'transient' GROUP BY l.level",
    "status_counts": f"WITH {CUR} SELECT level, status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY level), 2) AS percent FROM cur GROUP BY level, status",
    "relation_tallies": f"WITH {CUR}, {EDG} SELECT relation, s.level AS src_level, t.level AS tgt_level, count(*) AS n FROM edg JOIN cur s ON s.node_id = src JOIN cur t ON t.node_id = tgt GROUP BY ALL",
    "dedup_rate": f"WITH {CUR} SELECT level, count(*) AS total, count(*) FILTER (status = 'merged') AS merged, round(count(*) FILTER (status = 'merged') / count(*), 6) AS rate FROM cur GROUP BY level",
    "union_distinct_ids": f"WITH {CUR}, g AS (SELECT DISTINCT node_id FROM cc_deleted) SELECT 'union' AS part, count(*) AS n FROM (SELECT node_id FROM cur UNION SELECT node_id FROM g) UNION ALL SELECT 'both', count(*) FROM (SELECT node_id FROM cur INTERSECT SELECT node_id FROM g) UNION ALL SELECT 'only_deleted', count(*) FROM (SELECT node_id FROM g EXCEPT SELECT node_id FROM cur)",
}
