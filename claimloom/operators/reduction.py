"""Reduction of levels: the components of a level become atoms of the level above, from the code up to the problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom import providers
from claimloom.functions.json import merged
from claimloom.ontology import DEFAULT_TYPE, LEVELS
from claimloom.operators import extract, graph
from claimloom.plans.lineage import cut

# The fields of a reply with reduced atoms.
REDUCED = "struct<reduced_atoms: array<struct<name: string, type: string, context: string>>>"
#: Characters of an atom's context that stand in a prompt.
CONTEXT_CHARS = 400
#: The four steps, from the lowest level.
STEPS = [(LEVELS[i], LEVELS[i - 1]) for i in range(4, 0, -1)]


def reduce_level(atoms: DataFrame, edges: DataFrame, batch: DataFrame, level: str, to_level: str, model: providers.Model | None = None, mode: str = "weak") -> tuple[DataFrame, DataFrame]:
    """New atoms of ``to_level`` and the edges to them, from the components of ``level`` that hold atoms of ``batch``.

    The model is asked once per component; its prompt has the component's atoms in
    order of their ids, as many as fit.  A new atom takes source_refs, code_body and
    provenance of the component's first atom in ``batch``; the provenance also gets
    ``phase`` and ``reduced_from``, the component's id.  Which atoms that is stands
    in the aggregates_to edges, one from each batch atom of the component to each of
    its new atoms, so no row grows with a component.
    """
    comp = graph.components_by_level(edges, atoms, level, mode)
    mine = cut(comp.join(batch.where(F.col("level") == level).select("node_id", "name", "type", "context", "source_refs", "code_body", "provenance"), "node_id"))
    head = F.lit(f"reduce {level} {to_level}\n")
    lines = mine.select(F.col("component").alias("source"), F.col("node_id").alias("pos"), F.to_json(F.struct("node_id", "name", "type", F.substring("context", 1, CONTEXT_CHARS).alias("context"))).alias("text"))
    asked = extract.prompts(lines, mark="\n").select("source", F.concat(head, "prompt").alias("prompt"))
    replies = providers.ask(asked, "source", model, task="reduce")
    said = replies.select(F.col("source").alias("component"), F.from_json(extract.fenced_json(F.col("reply")), REDUCED).alias("r")).select("component", F.posexplode("r.reduced_atoms").alias("i", "x"))
    first = Window.partitionBy("component").orderBy("node_id")
    lead = mine.withColumn("n", F.row_number().over(first)).where("n = 1").select("component", "source_refs", "code_body", F.col("provenance").alias("old"))
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(to_level), "component", F.col("i").cast("string")), 256), 1, 12)
    patch = F.to_json(F.struct(F.col("component").alias("reduced_from"), F.lit("reduce").alias("phase")))
    new = said.join(lead, "component").select(
        "component",
        F.concat(F.lit(f"reduced_{to_level}_"), digest).alias("node_id"),
        F.coalesce("x.name", F.lit(f"Reduced {to_level}")).alias("name"),
        extract.valid_type(F.col("x.type"), F.lit(DEFAULT_TYPE[to_level])).alias("type"),
        F.lit(to_level).alias("level"),
        F.coalesce("x.context", F.lit("")).alias("context"),
        F.lit("active").alias("status"),
        "source_refs",
        "code_body",
        merged(F.col("old"), patch).alias("provenance"),
    )
    new = cut(new)
    up = mine.select("component", F.col("node_id").alias("src")).join(new.select("component", F.col("node_id").alias("tgt")), "component").select("src", "tgt", F.lit("aggregates_to").alias("relation"))
    return new.drop("component"), up


def reduce_all(atoms: DataFrame, edges: DataFrame, batch: DataFrame, model: providers.Model | None = None, mode: str = "weak") -> tuple[DataFrame, DataFrame]:
    """New atoms and edges of all four steps.

    As in a batch of new sources, each step takes the batch's own atoms of its level;
    atoms made by one step are part of the graph in the next, but not of the batch.
    """
    all_new, all_up = None, None
    have = atoms.select("node_id", "level")
    for level, to_level in STEPS:
        new, up = reduce_level(have, edges, batch, level, to_level, model, mode)
        up = cut(up)
        have = have.unionByName(new.select("node_id", "level")).distinct()
        edges = edges.select("src", "tgt", "relation").unionByName(up)
        all_new = new if all_new is None else all_new.unionByName(new)
        all_up = up if all_up is None else all_up.unionByName(up)
    return all_new, all_up
