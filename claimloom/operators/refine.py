"""Refinement: rounds of validation and fixes by a model, merging of duplicates, demotion of what stays without provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import providers
from claimloom.operators import extract, validate
from claimloom.plans.lineage import cut
from claimloom.schema import with_provenance

# The fields of a reply with fixes.
FIXES = "struct<fixes: array<struct<action: string, node_id: string, type: string, level: string, context: string, src: string, tgt: string, relation: string, provenance: string, rho: string>>>"


def parse_fixes(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replies (source, reply) to atom updates, edge updates and edge removals; a reply that is no JSON gives nothing.

    ``seq`` is an action's place in its reply: of several for one target the last wins.
    """
    rows = replies.select("source", F.from_json(extract.fenced_json(F.col("reply")), FIXES).alias("r")).where("r is not null")
    one = rows.select("source", F.posexplode("r.fixes").alias("seq", "x")).select("source", "seq", "x.*")
    known = lambda c: F.nullif(F.nullif(F.col(c), F.lit("{}")), F.lit("null")).alias(c)
    atoms = one.where("action = 'update_atom'").select("seq", "node_id", "type", "level", "context", known("provenance"))
    edges = one.where("action = 'update_edge'").select("seq", "src", "tgt", "relation", known("rho").alias("rho_json"))
    return atoms, edges, one.where("action = 'remove_edge'").select("src", "tgt")


def fix_prompts(atoms: DataFrame, edges: DataFrame, errors: DataFrame) -> DataFrame:
    """(source, prompt): for every source its errors, atoms and edges, one a line, cut to what a prompt takes."""
    home = atoms.select("node_id", F.coalesce("source_pdf", F.lit("")).alias("source"))
    line = lambda kind, *cols: F.concat(F.lit(f"{kind} "), F.to_json(F.struct(*cols)))
    a = atoms.select(F.coalesce("source_pdf", F.lit("")).alias("source"), F.lit(1).alias("part"), "node_id", line("atom", "node_id", "name", "type", "level", "context").alias("text"))
    e = edges.join(home.withColumnRenamed("node_id", "src"), "src").select("source", F.lit(2).alias("part"), F.concat_ws("->", "src", "tgt").alias("node_id"), line("edge", "src", "relation", "tgt").alias("text"))
    of_atoms = errors.join(home, errors["target"] == home["node_id"]).select("source", "rule", "target", "message")
    of_edges = errors.where(F.col("target").contains("->")).join(home, F.split("target", "->")[0] == home["node_id"]).select("source", "rule", "target", "message")
    x = of_atoms.unionByName(of_edges).distinct().select("source", F.lit(0).alias("part"), F.col("target").alias("node_id"), F.format_string("error [%s] %s: %s", "rule", "target", "message").alias("text"))
    lines = x.unionByName(a.join(x.select("source").distinct(), "source", "left_semi")).unionByName(e.join(x.select("source").distinct(), "source", "left_semi"))
    return extract.prompts(lines.select("source", F.struct("part", "node_id").alias("pos"), "text"), mark="\n").select("source", "prompt")


def refine(atoms: DataFrame, edges: DataFrame, model: providers.Model | None = None, max_rounds: int = 3) -> tuple[DataFrame, DataFrame, dict]:
    """Atoms and edges after at most ``max_rounds`` rounds, and the log: rounds, errors_found and errors_fixed per round.

    A round validates.  If only duplicates (R5) are left, they are merged; else the
    model is asked once per source for fixes of the others, which are applied, and
    the duplicates are seen again in the next round.  What still lacks provenance in
    the end is demoted.  The lineage is cut each round.
    """
    log: dict = {"rounds": 0, "errors_found": [], "errors_fixed": []}
    check = lambda a, e: cut(validate.validate(with_provenance(a), e))
    atoms, edges = cut(atoms), cut(edges)
    errors = check(atoms, edges)
    found = errors.count()
    for i in range(max_rounds):
        if not found:
            break
        log["rounds"] = i + 1
        log["errors_found"].append(found)
        fixable = errors.where("rule <> 'R5'")
        if fixable.isEmpty():
            mapping = cut(validate.merge_map(atoms))
            edges = cut(validate.rewrite_ends(edges, mapping))
            atoms = cut(atoms.join(mapping.select(F.col("dup_id").alias("node_id")), "node_id", "left_anti").select(*atoms.columns))
        else:
            replies = cut(providers.ask(fix_prompts(atoms, edges, fixable), "source", model, task="fix"))
            updates, edge_updates, removals = parse_fixes(replies)
            atoms = cut(validate.apply_atom_updates(atoms, updates))
            edges = cut(validate.apply_edge_actions(edges, edge_updates, removals))
        errors = check(atoms, edges)
        left = errors.count()
        log["errors_fixed"].append(max(0, found - left))
        found = left
    demoted = validate.demote(with_provenance(atoms))
    return demoted.select(*atoms.columns), edges, log
