"""Queries of the ingest pipeline: second phase, refinement, reduction, audit with write-back, services, bundles, with SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import ontology as O
from claimloom import providers
from claimloom.functions import json as J
from claimloom.functions.text import present
from claimloom.operators import audit, consolidate, extract, novelty, reduction, refine, reports, store, validate
from claimloom.plans.lineage import cut
from claimloom.plans.tables import table
from claimloom.queries.graph_store import BLANK, CUR, EDG, KEY, PROV, _in, _map, atoms_, edges_
from claimloom.schema import ATOMS, as_record, conform, edge_keys, with_provenance
from claimloom.sources import okf, report

Query = Callable[[SparkSession, str], DataFrame]
#: What experiments are checked against in the audit query.
SPEC = {"task_name": "grid", "eval_harness": "v1", "success_criteria": "win rate", "constraints": []}


def vectors_all_levels(spark, d):
    return store.vectors(atoms_(spark, d, "embedding")).select("node_id", F.size("embedding").alias("dim"))


def level_counts_all(spark, d):
    return reports.level_counts(atoms_(spark, d))


def records_without_nulls(spark, d):
    """Rows as JSON objects without null fields: their fields and sizes."""
    a = atoms_(spark, d, "code_body").select("node_id", "name", "code_body", "source_pdf")
    r = a.select("node_id", as_record(a).alias("r"))
    return r.select("node_id", F.array_join(F.array_sort(F.json_object_keys("r")), ",").alias("fields"))


def schema_of_older_tables(spark, d):
    """A table without the columns that came later, read in the present layout."""
    old = table(spark, d, "cc_nodes").drop("code_body", "source_refs", "provenance")
    new = conform(old, ATOMS)
    return new.select("node_id", "version", "name", F.lit(len(new.columns)).alias("n_columns"), F.col("provenance").isNull().alias("added"))


def last_wins_problem(spark, d):
    """Of several problems of one source the last, by time and id."""
    w1 = atoms_(spark, d).where((F.col("level") == O.LEVELS[0]) & F.col("source_pdf").isNotNull()).select("source_pdf", "node_id", "name", F.coalesce("created_at", F.lit("1900-01-01").cast("timestamp_ntz")).alias("at"))
    return novelty.last_wins(w1, ["source_pdf"], [F.col("at"), F.col("node_id")]).select("source_pdf", "node_id", "name")


def _code_replies(spark, d):
    m = table(spark, d, "merge_decisions").where("canonical_name <> ''").groupBy("decision_id").agg(*[F.min(c).alias(c) for c in ("canonical_name", "canonical_context", "reasoning", "level")])
    rho = F.when(F.length("reasoning") > 0, F.struct(F.col("reasoning").alias("mechanism"), F.lit(0.5).alias("confidence")))
    code = F.struct(F.concat("canonical_name", F.lit(" code")).alias("name"), F.lit("experiment").alias("type"), F.lit("main.py").alias("code_ref"))
    one = F.struct(F.col("canonical_name").alias("name"), F.col("canonical_context").alias("context"), F.lit("no such type").alias("type"), F.substring("canonical_name", 1, 5).alias("parent_W3_id"), F.array(F.upper("canonical_name"), F.lit("elsewhere")).alias("extends"), rho.alias("extends_rho"), F.array(code).alias("W5_code"))
    return m.select(F.col("decision_id").cast("string").alias("source"), "canonical_name", F.to_json(F.struct(F.array(one).alias("W4_implementations"))).alias("reply"))


def _phase2(spark, d):
    r = cut(_code_replies(spark, d))
    approaches = r.select("source", F.col("canonical_name").alias("name"), F.lit(0).alias("pos"), F.concat(F.lit("w3_"), "source").alias("parent_id"))
    return extract.parse_phase2(r.select("source", "reply"), approaches)


def parse_code_atoms(spark, d):
    atoms, _ = _phase2(spark, d)
    return atoms.select("source", "level", "name", "type", "context", "code_ref", F.get_json_object("provenance", "$.code_span").alias("code_span"), F.get_json_object("provenance", "$.via").alias("via"))


def parse_code_edges(spark, d):
    atoms, edges = _phase2(spark, d)
    names = atoms.select(F.col("node_id").alias("tgt"), F.lit(True).alias("known"))
    return edges.join(names, "tgt", "left").groupBy("relation", F.coalesce("known", F.lit(False)).alias("to_new_atom"), F.get_json_object("rho_json", "$.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def edge_update_actions(spark, d):
    """Decisions as fixes of the edges between an atom and its parent: accepted ones set relation and evidence, rejected ones remove."""
    m = table(spark, d, "merge_decisions").where(present(F.col("parent_id")) & present(F.col("canonical_id"))).select("decision_id", "do_merge", "parent_id", "canonical_id", "reasoning").distinct()
    up = m.where("do_merge").select(F.col("decision_id").alias("seq"), F.col("parent_id").alias("src"), F.col("canonical_id").alias("tgt"), F.lit("related_to").alias("relation"), F.nullif("reasoning", F.lit("")).alias("rho_json"))
    gone = m.where(~F.col("do_merge")).select(F.col("parent_id").alias("src"), F.col("canonical_id").alias("tgt"))
    e = edges_(spark, d).select("src", "tgt", "relation", "rho_json")
    return validate.apply_edge_actions(e, up, gone).groupBy("src", "tgt", "relation").agg(F.count(F.lit(1)).alias("n"), F.max("rho_json").alias("rho_json"))


def provenance_merge(spark, d):
    """The provenance of merged atoms after two updates, the second over the first."""
    a = atoms_(spark, d, "provenance").where("status = 'merged'")
    act = a.select("node_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit('{"phase":"a","first":1}').alias("p")), F.struct(F.lit(2).alias("seq"), F.lit('{"phase":"b"}').alias("p")))).alias("x"))
    none = F.lit(None).cast("string")
    out = validate.apply_atom_updates(a, act.select("x.seq", "node_id", none.alias("type"), none.alias("level"), none.alias("context"), F.col("x.p").alias("provenance")))
    get = lambda k: F.get_json_object("provenance", f"$.{k}").alias(k)
    return out.select("node_id", get("phase"), get("first"), get("raw_citation"))


def refine_log(spark, d):
    """Rounds of refinement of all atoms and edges by the offline model: errors found and mended."""
    a = conform(atoms_(spark, d, "provenance", "embedding", "tags"), ATOMS)
    log = refine.refine(a, edges_(spark, d).select("src", "tgt", "relation", "weight", "rho_json"))[2]
    rows = [(i, *x) for i, x in enumerate(zip(log["errors_found"], log["errors_fixed"], strict=True))]
    return spark.createDataFrame(rows, "round int, errors_found long, errors_fixed long")


def _reduced(spark, d):
    a = atoms_(spark, d, "provenance", "source_refs", "code_body")
    return reduction.reduce_all(cut(a.select("node_id", "level")), cut(edge_keys(table(spark, d, "cc_edges"))), cut(a.where("status = 'active'")))


def reduce_all_levels(spark, d):
    """New atoms of all four steps, the active atoms being the batch."""
    new, _ = _reduced(spark, d)
    return new.select("level", F.get_json_object("provenance", "$.reduced_from").alias("reduced_from"), "name", "type", F.get_json_object("provenance", "$.phase").alias("phase"), "code_body")


def reduction_edges(spark, d):
    """Edges of all four steps from the batch's atoms to what their component became."""
    new, up = _reduced(spark, d)
    named = new.select(F.col("node_id").alias("tgt"), "level", F.get_json_object("provenance", "$.reduced_from").alias("reduced_from"))
    return up.join(named, "tgt").select("src", "level", "reduced_from", "relation")


def _catalogue(spark, d):
    key = F.get_json_object(F.when(F.try_parse_json("refs").isNotNull(), F.col("refs")), "$.cites")
    return table(spark, d, "cc_nodes").select(key.alias("key")).where("key is not null").distinct().withColumn("resolved", F.to_json(F.struct(F.col("key").alias("title"))))


def audit_only_active(spark, d):
    """The audit of the base with write-back: what atoms are after it, by their status before."""
    a = atoms_(spark, d, "provenance", "code_body")
    after, _, _ = audit.verify(cut(a), cut(edge_keys(table(spark, d, "cc_edges"))), spec=SPEC, catalogue=_catalogue(spark, d), k=3)
    return after.select("node_id", "status", F.get_json_object(F.when(F.try_parse_json("provenance").isNotNull(), F.col("provenance")), "$.resolved.title").alias("resolved"))


def audit_cards(spark, d):
    """Report cards of the audit, one per collection."""
    a = atoms_(spark, d, "provenance", "code_body")
    _, _, per = audit.verify(cut(a), cut(edge_keys(table(spark, d, "cc_edges"))), spec=SPEC, catalogue=_catalogue(spark, d), k=1)
    named = a.select("node_id", F.coalesce(F.split("source_pdf", "/")[0], F.lit("unknown")).alias("collection"))
    return reports.audit_cards(per.join(named, "node_id"), "collection")


def consolidate_totals(spark, d):
    """Consolidation with the offline judge: merged atoms, clusters and the levels that had any."""
    a = conform(atoms_(spark, d, "embedding", "provenance"), ATOMS)
    v = a.where(F.size("embedding") == 64).select("node_id", "embedding")
    judge = lambda found, of: consolidate.adjudicate(found, of)
    rep = consolidate.consolidate(cut(a), cut(edges_(spark, d)), v, 0.9, judge)[2]
    t = consolidate.totals(rep)
    return t.select("atoms_merged", "clusters_formed", F.array_join("levels_processed", ",").alias("levels_processed"))


def service_replies(spark, d):
    """Replies of the services about every citation, made of its parts; each citation is answered by the first that has it."""
    a = with_provenance(atoms_(spark, d, "provenance")).where("raw_citation is not null").select("node_id", "raw_citation")
    n = F.length("raw_citation")
    doi = F.concat(F.lit("10."), n.cast("string"))
    who = F.struct(F.substring("raw_citation", 1, 7).alias("name"))
    s2 = F.to_json(F.struct(F.array(F.struct(F.col("raw_citation").alias("title"), F.array_repeat(who, 9).alias("authors"), n.alias("year"), F.struct(doi.alias("DOI")).alias("externalIds"))).alias("data")))
    oa = F.to_json(F.struct(F.array(F.struct(F.col("raw_citation").alias("title"), F.concat(F.lit("https://doi.org/"), doi).alias("doi"), n.alias("publication_year"))).alias("results")))
    cr = F.to_json(F.struct(F.struct(F.array(F.struct(doi.alias("DOI"), F.array("raw_citation").alias("title"), F.array(F.struct(F.lit("A").alias("given"), F.lit("B").alias("family"))).alias("author"), F.struct(F.array(F.array(n)).alias("date-parts")).alias("issued"))).alias("items")).alias("message")))
    feed = F.concat(F.lit("<feed><entry><title>"), F.regexp_replace("raw_citation", "[<>&]", " "), F.lit("</title><published>2020-01-01</published><name>C</name></entry></feed>"))
    when = lambda low, high, c: F.when((n >= low) & (n < high), c)
    asked = a.select("node_id", "raw_citation", when(0, 60, s2).alias("semantic_scholar"), when(60, 75, feed).alias("arxiv"), when(75, 90, oa).alias("openalex"), F.when(n >= 90, cr).alias("crossref"))
    r = providers.resolve_replies(asked)
    return r.select("node_id", "resolved.source_api", "resolved.doi", "resolved.year", F.size("resolved.authors").alias("n_authors"), F.get("resolved.authors", F.lit(0)).alias("author"), "resolved.confidence", F.md5(F.col("resolved.title").cast("binary")).alias("title_digest"))


def bundle_import(spark, d):
    """All atoms written as bundle files and read again."""
    a = with_provenance(atoms_(spark, d, "provenance", "tags", "code_body", "updated_at")).where(F.col("level").isin(O.LEVELS))
    files = okf.concepts(a, edge_keys(table(spark, d, "cc_edges")))
    got = okf.to_atoms(okf.split_front(files.select("path", F.col("content").alias("text"))))
    return got.select("node_id", "type", "level", "status", "source_pdf", F.md5(F.col("name").cast("binary")).alias("name_digest"), F.length("code_body").alias("n_code"))


def pages_by_checks(spark, d):
    """Atoms of a page with the checks of two reports, of which the later one wins."""
    a = atoms_(spark, d).select("node_id", "type", "status")
    v = a.where("type = 'numerical'").select("node_id", F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.create_map(F.lit("I1"), F.lit("failed")).alias("checks")), F.struct(F.lit(2).alias("pos"), F.create_map(F.lit("I1"), F.lit("passed")).alias("checks")))).alias("x")).select("node_id", "x.pos", "x.checks")
    return report.with_checks(a, v).select("node_id", "type", F.element_at("checks", F.lit("I1")).alias("i1"))


def merged_trace(spark, d):
    """The trace that merges leave in the provenance: where a duplicate went, and how many a canonical atom took up."""
    m = table(spark, d, "merge_decisions").where(F.col("do_merge") & present(F.col("canonical_id"))).select("canonical_id", F.explode("dup_ids").alias("dup_id"))
    m = m.where(present(F.col("dup_id")) & (F.col("dup_id") != F.col("canonical_id"))).groupBy("dup_id").agg(F.min("canonical_id").alias("canonical_id"))
    a, _ = consolidate.apply_merges(atoms_(spark, d, "provenance"), edges_(spark, d), m)
    touched = a.where("merged_into is not null or merged_from is not null")
    return touched.select("node_id", F.get_json_object("provenance", "$.merged_into").alias("into"), F.size(J.strings(F.col("provenance"), "merged_from")).alias("n_from"), F.get_json_object("provenance", "$.phase").alias("phase"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        vectors_all_levels, level_counts_all, records_without_nulls, schema_of_older_tables, last_wins_problem, parse_code_atoms, parse_code_edges, edge_update_actions, provenance_merge, refine_log, reduce_all_levels, reduction_edges, audit_only_active, audit_cards, consolidate_totals, service_replies, bundle_import, pages_by_checks, merged_trace,
    )
}

_REP2 = "rep AS (SELECT decision_id::VARCHAR AS source, min(canonical_name) AS n, min(canonical_context) AS c, min(reasoning) AS r FROM merge_decisions WHERE canonical_name <> '' GROUP BY decision_id)"
_MRG = f"mrg AS (SELECT dup_id, min(canonical_id) AS canonical_id FROM (SELECT canonical_id, unnest(dup_ids) AS dup_id FROM merge_decisions WHERE do_merge) WHERE dup_id <> canonical_id AND NOT regexp_matches(dup_id, {BLANK}) AND NOT regexp_matches(canonical_id, {BLANK}) GROUP BY dup_id)"
# Components of all levels at once: edges inside a level link its atoms.
_COMPS = """lv AS (SELECT DISTINCT src, tgt FROM ek JOIN cur s ON s.node_id = src JOIN cur t ON t.node_id = tgt WHERE s.level = t.level AND src <> tgt),
  arcs AS (SELECT src AS a, tgt AS b FROM lv UNION SELECT tgt, src FROM lv),
  rch AS (SELECT a, b FROM arcs UNION SELECT r.a, x.b FROM rch r JOIN arcs x ON x.a = r.b),
  comp AS (SELECT node_id, least(node_id, coalesce(min(b), node_id)) AS component FROM cur LEFT JOIN rch ON a = node_id GROUP BY node_id),
  batch AS (SELECT c.component, a.* FROM comp c JOIN cur a ON a.node_id = c.node_id WHERE a.status = 'active')"""
_UP = _map({O.LEVELS[i]: O.LEVELS[i - 1] for i in range(1, 5)})
_KIDS = """kids AS (SELECT src AS node_id, string_agg(body, chr(10) ORDER BY tgt) AS code FROM (
  SELECT src, tgt, coalesce(code_body, context) AS body FROM (SELECT DISTINCT src, tgt FROM ek WHERE relation = 'decomposes_into') JOIN cur ON node_id = tgt WHERE type = 'component' AND status = 'active'
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY tgt) <= 3) GROUP BY src)"""
_CATALOGUE = "cat AS (SELECT DISTINCT refs->>'$.cites' AS key FROM cc_nodes WHERE json_valid(refs) AND refs->>'$.cites' IS NOT NULL)"
_CHECKED = f"""chk AS (
  SELECT p.node_id, p.type, {_map(O.TYPE_CHECKS)}[p.type] AS chk,
    CASE p.type
      WHEN 'numerical' THEN CASE WHEN score IS NULL OR re IS NULL THEN 'skipped' WHEN abs(re - score) <= greatest(0.01 * sz, CASE WHEN coalesce(score_std, 0) > 0 THEN 3 * score_std / sz ELSE 0 END) THEN 'passed' ELSE 'failed' END
      WHEN 'experiment' THEN CASE WHEN contains(substr(coalesce(code_body, context), 1, 2000), 'assert') THEN 'passed' ELSE 'failed' END
      WHEN 'citation' THEN CASE WHEN raw_citation IS NULL THEN 'skipped' WHEN raw_citation IN (SELECT key FROM cat) THEN 'passed' ELSE 'failed' END
      ELSE CASE WHEN k.node_id IS NULL THEN 'skipped' WHEN contains(substr(p.context, 1, 1000) || chr(10) || substr(k.code, 1, 3000), 'return') THEN 'passed' ELSE 'failed' END END AS res,
    p.type IN ('method', 'solution') AND contains(substr(p.context, 1, 1000) || chr(10) || substr(k.code, 1, 3000), 'if ') AS soft
  FROM (SELECT *, TRY_CAST(nullif(regexp_extract(substr(context, 1, 1000), '\\d+\\.\\d+'), '') AS DOUBLE) AS re, CASE WHEN score = 0 THEN 1e-9 ELSE abs(score) END AS sz FROM prov) p LEFT JOIN kids k ON k.node_id = p.node_id
  WHERE p.status = 'active'),
new AS (SELECT *, CASE WHEN chk IS NULL THEN 'skipped' WHEN res = 'failed' AND (type = 'numerical' OR soft) THEN 'low_confidence' WHEN res = 'failed' THEN 'low_reliability' ELSE 'verified' END AS status FROM chk)"""

SQL: dict[str, str] = {
    "vectors_all_levels": f"WITH {CUR} SELECT node_id, len(embedding)::INT AS dim FROM cur WHERE len(embedding) > 0",
    "level_counts_all": f"WITH {CUR}, l(level) AS (VALUES {', '.join(f"('{x}')" for x in O.LEVELS)}) SELECT l.level, count(node_id) AS n FROM l LEFT JOIN cur c ON c.level = l.level GROUP BY l.level",
    "records_without_nulls": f"WITH {CUR} SELECT node_id, concat_ws(',', CASE WHEN code_body IS NOT NULL THEN 'code_body' END, CASE WHEN name IS NOT NULL THEN 'name' END, 'node_id', CASE WHEN source_pdf IS NOT NULL THEN 'source_pdf' END) AS fields FROM cur",
    "schema_of_older_tables": "SELECT node_id, version, name, 18 AS n_columns, true AS added FROM cc_nodes",
    "last_wins_problem": f"WITH {CUR} SELECT source_pdf, arg_max(node_id, k) AS node_id, arg_max(coalesce(name, chr(0)), k) AS name FROM (SELECT *, (coalesce(created_at, TIMESTAMP '1900-01-01'), node_id) AS k FROM cur WHERE level = 'W1_problem' AND source_pdf IS NOT NULL) GROUP BY source_pdf",
    "parse_code_atoms": f"""WITH {_REP2} SELECT source, 'W4_implementation' AS level, n AS name, 'solution' AS type, coalesce(c, '') AS context, NULL AS code_ref, NULL AS code_span, 'phase2' AS via FROM rep
      UNION ALL SELECT source, 'W5_code', n || ' code', 'experiment', '', 'main.py', 'main.py', 'phase2' FROM rep""",
    "parse_code_edges": f"""WITH {_REP2}, e AS (SELECT 'decomposes_into' AS relation, true AS to_new_atom, NULL AS confidence FROM rep UNION ALL SELECT 'decomposes_into', true, NULL FROM rep UNION ALL SELECT 'aggregates_to', false, NULL FROM rep
      UNION ALL SELECT 'extends', true, CASE WHEN length(r) > 0 THEN '0.5' END FROM rep UNION ALL SELECT 'extends', false, CASE WHEN length(r) > 0 THEN '0.5' END FROM rep)
      SELECT relation, to_new_atom, confidence, count(*) AS n FROM e GROUP BY ALL""",
    "edge_update_actions": f"""WITH {EDG}, m AS (SELECT DISTINCT decision_id, do_merge, parent_id, canonical_id, reasoning FROM merge_decisions WHERE NOT regexp_matches(parent_id, {BLANK}) AND NOT regexp_matches(canonical_id, {BLANK})),
      u AS (SELECT parent_id AS src, canonical_id AS tgt, arg_max(reasoning, decision_id) FILTER (reasoning <> '') AS r FROM m WHERE do_merge GROUP BY ALL)
      SELECT e.src, e.tgt, CASE WHEN u.src IS NOT NULL THEN 'related_to' ELSE relation END AS relation, count(*) AS n, max(coalesce(u.r, rho_json)) AS rho_json FROM edg e LEFT JOIN u ON u.src = e.src AND u.tgt = e.tgt
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE NOT do_merge AND parent_id = e.src AND canonical_id = e.tgt) GROUP BY ALL""",
    "provenance_merge": f"WITH {CUR} SELECT node_id, 'b' AS phase, '1' AS first, CASE WHEN json_valid(provenance) THEN provenance->>'$.raw_citation' END AS raw_citation FROM cur WHERE status = 'merged'",
    "reduce_all_levels": f"""WITH RECURSIVE {CUR}, {KEY}, {_COMPS}, lead AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY component ORDER BY node_id) = 1)
      SELECT {_UP}[level] AS level, component AS reduced_from, coalesce(name, '') || ' and like' AS name, CASE WHEN type IN {_in(O.TYPES)} THEN type ELSE {_map(O.DEFAULT_TYPE)}[{_UP}[level]] END AS type, 'reduce' AS phase, code_body FROM lead WHERE level IN {_in(O.LEVELS[1:])}""",
    "reduction_edges": f"WITH RECURSIVE {CUR}, {KEY}, {_COMPS} SELECT node_id AS src, {_UP}[level] AS level, component AS reduced_from, 'aggregates_to' AS relation FROM batch WHERE level IN {_in(O.LEVELS[1:])}",
    "audit_only_active": f"""WITH {CUR}, {PROV}, {KEY}, {_CATALOGUE}, {_KIDS}, {_CHECKED}
      SELECT c.node_id, coalesce(n.status, c.status) AS status, coalesce(CASE WHEN n.chk = 'I3' AND n.res = 'passed' THEN c.provenance->>'$.raw_citation' END, CASE WHEN json_valid(c.provenance) THEN c.provenance->>'$.resolved.title' END) AS resolved FROM cur c LEFT JOIN new n ON n.node_id = c.node_id""",
    "audit_cards": f"""WITH {CUR}, {PROV}, {KEY}, {_CATALOGUE}, {_KIDS}, {_CHECKED}, x AS (SELECT n.*, coalesce(string_split(c.source_pdf, '/')[1], 'unknown') AS collection FROM new n JOIN cur c ON c.node_id = n.node_id),
      g AS (SELECT collection, count(*) FILTER (chk IS NOT NULL) AS n_audited, count(*) FILTER (chk IS NOT NULL AND status = 'verified') AS n_passed, count(*) FILTER (chk IS NOT NULL AND status <> 'verified') AS n_failed, count(*) FILTER (chk IS NULL) AS n_skipped,
        coalesce(count(*) FILTER (type = 'numerical' AND status = 'verified') / nullif(count(*) FILTER (type = 'numerical'), 0), 0) AS cpr, {", ".join(f"count(*) FILTER (chk = '{c}' AND res = 'failed') AS failed_{c.lower()}" for c in ("I1", "I2", "I3", "I4"))} FROM x GROUP BY collection)
      SELECT * REPLACE (round(cpr, 6) AS cpr), CASE WHEN cpr >= 0.8 THEN 'good' WHEN cpr >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM g""",
    "service_replies": rf"""WITH {CUR}, {PROV}, a AS (SELECT node_id, raw_citation AS r, length(raw_citation) AS n FROM prov WHERE raw_citation IS NOT NULL),
      x AS (SELECT *, CASE WHEN trim(r) = '' THEN NULL WHEN n < 60 THEN 'semantic_scholar' WHEN n < 75 THEN 'arxiv' WHEN n < 90 THEN 'openalex' ELSE 'crossref' END AS api FROM a)
      SELECT node_id, api AS source_api, CASE WHEN api <> 'arxiv' THEN '10.' || n END AS doi, CASE WHEN api = 'arxiv' THEN 2020 WHEN api IS NOT NULL THEN n END::INT AS year,
        CASE api WHEN 'semantic_scholar' THEN 5 WHEN 'openalex' THEN 0 WHEN 'arxiv' THEN 1 WHEN 'crossref' THEN 1 END AS n_authors, CASE api WHEN 'semantic_scholar' THEN substr(r, 1, 7) WHEN 'arxiv' THEN 'C' WHEN 'crossref' THEN 'A B' END AS author,
        CASE api WHEN 'semantic_scholar' THEN 0.9 WHEN 'openalex' THEN 0.75 WHEN 'crossref' THEN 0.7 WHEN 'arxiv' THEN CASE WHEN regexp_matches(r, '(?i)(?:arxiv[:\s])?(\d{{4}}\.\d{{4,5}}(?:v\d+)?)') THEN 0.85 ELSE 0.6 END END::DOUBLE AS confidence,
        md5(CASE WHEN api = 'arxiv' THEN trim(regexp_replace(regexp_replace(r, '[<>&]', ' ', 'g'), '\s+', ' ', 'g')) WHEN api IS NOT NULL THEN r END) AS title_digest FROM x""",
    "bundle_import": f"""WITH {CUR} SELECT node_id, CASE WHEN type IN {_in(O.TYPES)} THEN type ELSE 'concept' END AS type, level, CASE WHEN status = '' THEN 'active' ELSE status END AS status, nullif(source_pdf, '') AS source_pdf,
      md5(coalesce(nullif(name, ''), node_id)) AS name_digest, length(nullif(code_body, ''))::INT AS n_code FROM cur WHERE level IN {_in(O.LEVELS)}""",
    "pages_by_checks": f"WITH {CUR} SELECT node_id, type, CASE WHEN type = 'numerical' THEN 'passed' END AS i1 FROM cur",
    "merged_trace": f"""WITH {CUR}, {_MRG}, fr AS (SELECT canonical_id, list(DISTINCT dup_id) AS ids FROM mrg GROUP BY 1)
      SELECT c.node_id, m.canonical_id AS "into", len(list_distinct(list_concat(coalesce(CASE WHEN json_valid(c.provenance) THEN CAST(json_extract(c.provenance, '$.merged_from') AS VARCHAR[]) END, []), coalesce(fr.ids, []))))::INT AS n_from, 'consolidate' AS phase
      FROM cur c LEFT JOIN mrg m ON m.dup_id = c.node_id LEFT JOIN fr ON fr.canonical_id = c.node_id WHERE m.dup_id IS NOT NULL OR fr.canonical_id IS NOT NULL""",
}
