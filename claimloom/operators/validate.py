"""Rule validation: every rule is a query for its errors (rule, target, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import ontology as O
from claimloom.functions.json import merged
from claimloom.plans.skew import salted_join


def _edge_target() -> Column:
    return F.concat_ws("->", "src", "tgt")


def _error(rule: str, target: Column, message: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.coalesce(target, F.lit("")).alias("target"), message.alias("message")]


def _several(df: DataFrame, rule: str, target: Column, *cases: tuple[Column, Column]) -> DataFrame:
    """One error for each case that holds for a row."""
    messages = F.filter(F.array(*[F.when(cond, msg) for cond, msg in cases]), lambda m: m.isNotNull())
    return df.select(target.alias("__t"), F.explode(messages).alias("__m")).select(*_error(rule, F.col("__t"), F.col("__m")))


def r1_atoms(atoms: DataFrame) -> DataFrame:
    """Empty id, unknown type, unknown level."""
    nid, t, lv = F.coalesce("node_id", F.lit("")), F.coalesce("type", F.lit("")), F.coalesce("level", F.lit(""))
    return _several(atoms, "R1", nid, (nid == "", F.lit("empty id")), (~t.isin(O.TYPES), F.concat(F.lit("unknown type "), t)), (~lv.isin(O.LEVELS), F.concat(F.lit("unknown level "), lv)))


def _held(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Edges with type and level of both ends, null where an end doesn't exist (D2, D3 in one pass)."""
    a = atoms.select("node_id", "type", "level")
    s = a.select(F.col("node_id").alias("src"), F.lit(True).alias("has_src"), F.col("type").alias("src_type"), F.col("level").alias("src_level"))
    t = a.select(F.col("node_id").alias("tgt"), F.lit(True).alias("has_tgt"), F.col("type").alias("tgt_type"), F.col("level").alias("tgt_level"))
    return salted_join(edges.join(s, "src", "left"), t, ["tgt"], "left")


def r1_edges(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Unknown relation, missing source, missing target; up to three errors per edge."""
    rel = F.coalesce("relation", F.lit(""))
    cases = [(~rel.isin(O.HORIZONTAL + O.HIERARCHY), F.concat(F.lit("unknown relation "), rel)), (F.col("has_src").isNull(), F.concat(F.lit("missing source "), "src")), (F.col("has_tgt").isNull(), F.concat(F.lit("missing target "), "tgt"))]
    return _several(_held(edges, atoms), "R1", _edge_target(), *cases)


def r2(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Pair of types that the relation doesn't allow; related_to, background and hierarchy relations are exempt."""
    h = _held(edges.where(F.col("relation").isin(list(O.MATRIX))), atoms).where("has_src and has_tgt")
    allowed = F.broadcast(O.matrix(edges.sparkSession))  # fixed values
    bad = h.join(allowed, ["relation", "src_type", "tgt_type"], "left_anti")
    return bad.select(*_error("R2", _edge_target(), F.concat_ws(" ", "relation", F.concat_ws(">", "src_type", "tgt_type"))))


def r3(edges: DataFrame) -> DataFrame:
    """Strong-causal edge without evidence."""
    return edges.where(F.col("relation").isin(O.STRONG_CAUSAL) & F.col("rho_json").isNull()).select(*_error("R3", _edge_target(), F.concat(F.lit("no evidence for "), "relation")))


def r4(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Hierarchy edge in the wrong direction: aggregates_to must go up, decomposes_into down."""
    h = _held(edges.where(F.col("relation").isin(O.HIERARCHY)), atoms).where("has_src and has_tgt")
    s, t = O.level_ordinal(F.col("src_level")), O.level_ordinal(F.col("tgt_level"))
    wrong = F.when(F.col("relation") == "aggregates_to", t >= s).otherwise(t <= s)
    return h.where(wrong).select(*_error("R4", _edge_target(), F.concat_ws(" ", "relation", F.concat_ws(">", "src_level", "tgt_level"))))


def r5(atoms: DataFrame) -> DataFrame:
    """Later atoms of the same lower-case name, type and level; the message names the first.

    The first of each key comes from an aggregation combined before its shuffle and
    is joined back, salted, so no key is gathered in one task.
    """
    key = [F.lower("name").alias("k"), "type", "level"]
    pos = F.struct(F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp_ntz")), "node_id")
    first = atoms.groupBy(*key).agg(F.min(pos).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", F.col("type").alias("kt"), F.col("level").alias("kl"), F.col("p.node_id").alias("first_id"))
    mine = atoms.select("node_id", F.lower("name").alias("k"), F.col("type").alias("kt"), F.col("level").alias("kl"))
    return salted_join(mine, first, ["k", "kt", "kl"]).where(F.col("node_id") != F.col("first_id")).select(*_error("R5", F.col("node_id"), F.concat(F.lit("duplicate of "), "first_id")))


def _r6_missing() -> Column:
    need = O.lookup(F.col("type"), O.REQUIRED_PROVENANCE)
    has = F.when(need == "score", F.col("score").isNotNull()).when(need == "raw_citation", F.col("raw_citation").isNotNull()).otherwise(F.col("provenance").isNotNull())
    return need.isNotNull() & ~has


def r6(atoms: DataFrame) -> DataFrame:
    """Atoms of known type and level without the provenance their type needs (promoted columns)."""
    known = atoms.where(F.col("type").isin(O.TYPES) & F.col("level").isin(O.LEVELS))
    return known.where(_r6_missing()).select(*_error("R6", F.col("node_id"), F.concat(F.lit("provenance needed for "), "type")))


def validate(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """All errors: of atoms, of edges, duplicates."""
    return reduce(DataFrame.unionByName, [r1_atoms(atoms), r6(atoms), r1_edges(edges, atoms), r3(edges), r2(edges, atoms), r4(edges, atoms), r5(atoms)])


def demote(atoms: DataFrame) -> DataFrame:
    """Fallback for R6: types with a weaker form take it (status demoted), others need review; ``mutated`` marks them."""
    miss = _r6_missing()
    weaker = O.lookup(F.col("type"), O.DEMOTIONS)
    status = F.when(miss, F.when(weaker.isNotNull(), "demoted").otherwise("needs_review")).otherwise(F.col("status"))
    return atoms.select(*[c for c in atoms.columns if c not in ("type", "status")], F.when(miss, F.coalesce(weaker, "type")).otherwise(F.col("type")).alias("type"), status.alias("status"), miss.alias("mutated"))


def merge_map(atoms: DataFrame) -> DataFrame:
    """(dup_id, canonical_id) of in-batch duplicates by R5."""
    return r5(atoms).select(F.col("target").alias("dup_id"), F.expr("substring(message, length('duplicate of ') + 1)").alias("canonical_id"))


def rewrite_ends(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with mapped ends; self loops and repeated edges stay, as a batch repair leaves them."""
    s = mapping.select(F.col("dup_id").alias("src"), F.col("canonical_id").alias("new_src"))
    t = mapping.select(F.col("dup_id").alias("tgt"), F.col("canonical_id").alias("new_tgt"))
    out = salted_join(edges.join(s, "src", "left"), t, ["tgt"], "left")
    return out.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_tgt", "tgt").alias("tgt"), *[c for c in edges.columns if c not in ("src", "tgt")])


# -- repair by listed actions (L11) ------------------------------------------


def apply_atom_updates(atoms: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions (seq, node_id, type, level, context, provenance): per field the last given value wins; provenance is merged, later fields over earlier ones."""
    last = actions.groupBy("node_id").agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in ("type", "level", "context")])
    new = ["type", "level", "context"]
    out = atoms.join(last, "node_id", "left")
    cols = {c: F.coalesce(f"new_{c}", c).alias(c) for c in new}
    if "provenance" in actions.columns and "provenance" in atoms.columns:
        given = actions.where(F.col("provenance").isNotNull()).groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("seq", "provenance"))).alias("p"))  # the fixes of one atom
        patch = F.aggregate("p", F.lit(None).cast("string"), lambda acc, x: merged(acc, x["provenance"]))
        out = out.join(given.select("node_id", patch.alias("patch")), "node_id", "left")
        cols["provenance"] = F.when(F.col("patch").isNotNull(), merged(F.col("provenance"), F.col("patch"))).otherwise(F.col("provenance")).alias("provenance")
    return out.select(*[cols.get(c, F.col(c)) for c in atoms.columns])


def apply_edge_actions(edges: DataFrame, updates: DataFrame, removals: DataFrame) -> DataFrame:
    """Updates (seq, src, tgt, relation, rho_json) hit all edges of a pair; removals (src, tgt) drop them."""
    last = updates.groupBy("src", "tgt").agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in ("relation", "rho_json")])
    out = edges.join(removals.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti").join(last, ["src", "tgt"], "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("relation", "rho_json") else F.col(c) for c in edges.columns])


# -- the older layer (v2) ----------------------------------------------------

# Fixed values of the older ontology.
V2_TYPES = ["method", "bottleneck", "paper", "fact", "component", "hypothesis", "experiment", "verification"]
V2_MATRIX = {
    "EXTENDS": [("method", "method")],
    "IMPROVES": [("method", "method"), ("method", "bottleneck")],
    "REPLACES": [("method", "method"), ("component", "component")],
    "ADAPTS": [("method", "method"), ("method", "bottleneck")],
    "USES_COMPONENT": [("method", "component")],
    "COMPARES": [("method", "method"), ("experiment", "method")],
    "IMPLEMENTS": [("method", "hypothesis"), ("method", "paper")],
    "VALIDATES": [("experiment", "hypothesis"), ("verification", "hypothesis"), ("method", "method")],
    "BOUNDARY_OF": [("fact", "method"), ("fact", "experiment")],
}
V2_RELATIONS = [*V2_MATRIX, "BACKGROUND", "RELATED_TO"]
V2_STRONG = ["EXTENDS", "IMPROVES", "REPLACES", "ADAPTS"]


def valid_name(c: Column) -> Column:
    """Two characters or more, not only digits, at least one ASCII letter or digit."""
    return F.coalesce((F.length(c) >= 2) & ~c.rlike(r"^\p{Nd}+$") & c.rlike("[A-Za-z0-9]"), F.lit(False))


def v2_validate(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Errors of a v2 blueprint: atoms (pos, name, type), edges (src, relation, tgt, has_rho); atoms keyed by name, the last wins."""
    bad_name = atoms.where(~valid_name(F.col("name"))).select(*_error("name", F.col("name"), F.lit("invalid name")))
    bad_type = atoms.where(~F.col("type").isin(V2_TYPES)).select(*_error("type", F.col("name"), F.concat(F.lit("invalid type "), "type")))
    named = atoms.groupBy("name").agg(F.max_by("type", "pos").alias("type"))
    s, t = named.select(F.col("name").alias("src"), F.col("type").alias("src_type")), named.select(F.col("name").alias("tgt"), F.col("type").alias("tgt_type"))
    e = edges.join(s, "src", "left").join(t, "tgt", "left")
    rows = [(rel, *p) for rel, pairs in V2_MATRIX.items() for p in pairs]
    allowed = F.broadcast(atoms.sparkSession.createDataFrame(rows, "relation string, src_type string, tgt_type string"))
    pair_bad = e.where(F.col("src_type").isNotNull() & F.col("tgt_type").isNotNull() & F.col("relation").isin(list(V2_MATRIX))).join(allowed, ["relation", "src_type", "tgt_type"], "left_anti")
    return reduce(
        DataFrame.unionByName,
        [
            bad_name,
            bad_type,
            e.where("src_type is null").select(*_error("endpoint", _edge_target(), F.concat(F.lit("no atom "), "src"))),
            e.where("tgt_type is null").select(*_error("endpoint", _edge_target(), F.concat(F.lit("no atom "), "tgt"))),
            e.where(F.col("relation").isin(V2_STRONG) & ~F.col("has_rho")).select(*_error("evidence", _edge_target(), F.concat(F.lit("no evidence for "), "relation"))),
            pair_bad.select(*_error("pair", _edge_target(), F.concat_ws(" ", "relation", F.concat_ws(">", "src_type", "tgt_type")))),
        ],
    )


def v2_filter(atoms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What extraction keeps: valid atoms; edges with both ends and, if strong-causal, evidence (incompatible pairs stay)."""
    kept = atoms.where(valid_name(F.col("name")) & F.col("type").isin(V2_TYPES))
    names = kept.select("name").distinct()
    ok = edges.where(~F.col("relation").isin(V2_STRONG) | F.col("has_rho"))
    ok = ok.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "tgt"), "tgt", "left_semi")
    return kept, ok


def v2_coerce(atoms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the validation tool does first: types in lower case, unknown ones become method; edges of unknown relation are dropped."""
    t = F.lower("type")
    a = atoms.withColumn("type", F.when(t.isin(V2_TYPES), t).otherwise("method"))
    return a, edges.withColumn("relation", F.upper("relation")).where(F.col("relation").isin(V2_RELATIONS))
