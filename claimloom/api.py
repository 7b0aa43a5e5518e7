"""The engine's facade: ingest, search, evaluate, consolidate, audit over a store of commits."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import ontology as O
from claimloom import providers
from claimloom.functions.vectors import literal_vector, word_hash
from claimloom.operators import audit, consolidate, extract, graph, novelty, reduction, refine, reports, store
from claimloom.operators import search as search_
from claimloom.plans.lineage import cut
from claimloom.schema import ATOMS, EDGES, conform

PROPOSAL = "__proposal__"


@dataclass
class Config:
    """Settings that affect results."""

    link_top_k: int = 10
    ppr_damping: float = 0.5
    code_bias: float = 0.05
    max_refine_rounds: int = 3
    audit_k: int = 5
    auto_consolidate: bool = True
    consolidate_k: int = 3
    similarity: float = 0.85
    rounds: int = graph.ROUNDS
    trusted: list[str] = field(default_factory=lambda: list(O.TRUSTED_STATUSES))


class Engine:
    """One knowledge base in a folder.  Every stage is a DataFrame; a call commits once, at its end.

    ``catalogue`` (key, resolved) is what citations are held against.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, model: providers.Model | None = None, catalogue: DataFrame | None = None):
        self.spark, self.store, self.config, self.model, self.catalogue = spark, store.GraphStore(spark, path), config or Config(), model, catalogue

    def _held(self) -> tuple[DataFrame, DataFrame, int]:
        """Atoms, edges and the commit that was read (0: none)."""
        versions = self.store.versions()
        if versions:
            return conform(self.store.read("atoms", versions[-1]), ATOMS), conform(self.store.read("edges", versions[-1]), EDGES), versions[-1]
        return self.spark.createDataFrame([], ATOMS), self.spark.createDataFrame([], EDGES), 0

    # -- stages ----------------------------------------------------------------

    def extract(self, segments: DataFrame, source: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Atoms and edges of the segments (pos, text and, unless ``source`` is given, source): two model calls per source."""
        seg = segments.select(F.lit(source).alias("source") if source is not None else F.col("source"), "pos", "text").where("text is not null")
        asked = cut(extract.prompts(seg))
        parsed = lambda p, task: cut(providers.ask(p, "source", self.model, task=task)).select("source", extract.fenced_json(F.col("reply")).alias("reply"))
        a1, e1 = extract.parse_phase1(parsed(asked, "extract"))
        a1 = cut(a1)
        approaches = a1.where("level = 'W3_approach'").select("source", "name", F.lit(0).alias("pos"), F.col("node_id").alias("parent_id"))
        a2, e2 = extract.parse_phase2(parsed(extract.followup_prompts(asked, a1), "extract_code"), approaches)
        atoms = conform(a1.withColumn("source_pdf", F.col("source")), ATOMS).unionByName(conform(a2.withColumn("source_pdf", F.col("source")), ATOMS))
        atoms = self.embed(store.first_wins(atoms.withColumns({"status": F.lit("active"), "version": F.lit(1)}), ["node_id"], [F.col("name")]))
        edges = conform(e1, EDGES).unionByName(conform(e2, EDGES)).withColumn("weight", F.lit(1.0))
        return atoms, edges

    def embed(self, atoms: DataFrame) -> DataFrame:
        """Atoms with the vectors of their names and contexts, made once and stored."""
        return atoms.withColumn("embedding", word_hash(F.concat_ws(" ", "name", "context")).cast("array<float>"))

    def ingest(self, segments: DataFrame, source: str | None = None, *, task_spec: dict | None = None, on_progress: Callable[[str, int], None] | None = None) -> dict:
        """Extract, refine, store, reduce, consolidate and audit; one commit.  Returns counts and reports.

        Atoms held already stay as they are.  ``task_spec`` (task_name, eval_harness,
        success_criteria, constraints) is what experiments are checked against.
        """
        say = on_progress or (lambda stage, pct: None)
        c = self.config
        say("extracting", 0)
        atoms, edges = self.extract(segments, source)
        say("refining", 20)
        atoms, edges, log = refine.refine(atoms, edges, self.model, c.max_refine_rounds)
        say("storing", 40)
        held_a, held_e, since = self._held()
        new_a = cut(store.insert_ignore(held_a, atoms, ["node_id"], [F.col("name")]))
        new_e = cut(store.insert_ignore(held_e, edges, store.EDGE_KEY, [F.col("weight"), F.col("rho_json").asc_nulls_last()]))
        counts = {"atoms_inserted": new_a.count(), "edges_inserted": new_e.count()}
        all_a, all_e = held_a.unionByName(new_a), held_e.unionByName(new_e)
        say("reducing", 50)
        made, up = reduction.reduce_all(all_a, all_e, atoms, self.model)
        made = self.embed(conform(made, ATOMS).withColumn("version", F.lit(1)))
        all_a = cut(store.upsert_atoms(all_a, made))
        all_e = cut(all_e.unionByName(store.insert_ignore(all_e, conform(up, EDGES).withColumn("weight", F.lit(1.0)), store.EDGE_KEY, [F.col("weight")])))
        counts["atoms_reduced"] = made.count()
        merges = None
        if c.auto_consolidate:
            say("consolidating", 70)
            all_a, all_e, rep = self._consolidated(all_a, all_e)
            merges = {"per_level": [r.asDict() for r in rep.collect()], **consolidate.totals(rep).first().asDict()}  # five rows
        say("auditing", 85)
        all_a, report, _ = audit.verify(all_a, all_e, model=self.model, spec=task_spec, catalogue=self.catalogue, k=c.audit_k)
        self._save(held_a, held_e, cut(all_a), all_e, since)
        say("done", 100)
        base = self.store.atoms
        return counts | {
            "refine_log": log,
            "levels": {r["level"]: r["n"] for r in reports.level_counts(base).collect()},
            "trajectories": base.where((F.col("level") == O.LEVELS[4]) & F.col("status").isin(c.trusted)).count(),
            "consolidate_report": merges,
            "audit_report": report.first().asDict(),
        }

    def _save(self, held_a: DataFrame, held_e: DataFrame, atoms: DataFrame, edges: DataFrame, since: int) -> None:
        """One commit: new rows are appended if no row held has changed or gone, else both tables are written anew."""
        if since:
            kept_e = [F.col("weight").alias("w1"), F.col("rho_json").alias("r1")]
            lost = held_e.join(edges.select(*store.EDGE_KEY, *kept_e), store.EDGE_KEY, "left").where(~(F.col("weight").eqNullSafe(F.col("w1")) & F.col("rho_json").eqNullSafe(F.col("r1"))))
            seen = ["name", "type", "level", "context", "status", "provenance", "version"]
            same = lambda df, name: df.select("node_id", F.xxhash64(*[F.coalesce(F.col(x).cast("string"), F.lit("\0")) for x in seen]).alias(name))
            changed = same(held_a, "h0").join(same(atoms, "h1"), "node_id", "left").where(~F.col("h0").eqNullSafe(F.col("h1")))
            if changed.isEmpty() and lost.isEmpty():
                new_a = atoms.join(held_a.select("node_id"), "node_id", "left_anti")
                new_e = edges.join(held_e.select(*store.EDGE_KEY), store.EDGE_KEY, "left_anti")
                self.store.append(new_a, new_e, since=since)
                return
        self.store.commit(atoms, edges, since=since)

    def _consolidated(self, atoms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        c = self.config
        vectors = atoms.where(F.size("embedding") > 0).select("node_id", "embedding")
        judge = lambda found, of: consolidate.adjudicate(found, of, self.model, c.consolidate_k)
        a, e, rep = consolidate.consolidate(atoms, edges, vectors, c.similarity, judge)
        before = atoms.select("node_id", F.col("context").alias("__c"), F.col("name").alias("__n"))
        moved = ~(F.col("context").eqNullSafe(F.col("__c")) & F.col("name").eqNullSafe(F.col("__n")))
        fresh = word_hash(F.concat_ws(" ", "name", "context")).cast("array<float>")
        return conform(cut(a.join(before, "node_id", "left").withColumn("embedding", F.when(moved, fresh).otherwise(F.col("embedding")))), ATOMS), conform(e, EDGES), rep

    # -- calls -----------------------------------------------------------------

    def search(self, query: str, top_k: int = 10, level: str = "W4", status: str | None = None) -> DataFrame:
        """(node_id, name, type, score, context, source_pdf, status): the best atoms of a level."""
        atoms, edges, _ = self._held()
        q = lambda instruction: literal_vector(self.spark, providers.embed(F.lit(query), instruction))
        c = self.config
        have = atoms.where(F.size("embedding") > 0).select("node_id", "embedding")
        return search_.search(atoms, edges, have, q("Represent this query for atom retrieval"), q("Represent this query for code passage retrieval"), level=level, top_k=top_k, link_top_k=c.link_top_k, status_filter=store.status_included(status), damping=c.ppr_damping, rounds=c.rounds)

    def evaluate(self, segments: DataFrame, domain: str | None = None) -> dict:
        """Nearest known trajectory of a proposal, distances by level, novelty score and the model's rubric; the proposal is never stored.

        Of several problems the last counts.  ``domain`` takes only trajectories of
        code atoms tagged with it.
        """
        atoms, edges, _ = self._held()
        mine = cut(self.extract(segments, PROPOSAL)[0])
        top = novelty.last_wins(mine.where(F.col("level") == O.LEVELS[0]).withColumn("one", F.lit(1)), ["one"], [F.col("node_id")]).drop("one").select(mine.columns)
        mine = cut(top.unionByName(mine.where(F.col("level") != O.LEVELS[0])))
        chains = graph.trajectories(edges, atoms, self.config.trusted)
        if domain is not None:
            chains = chains.join(store.by_domain(atoms, domain).select(F.col("node_id").alias("w5")), "w5", "left_semi")
        chains = cut(chains)
        usable = atoms.where(F.size("embedding") > 0)
        proposal = mine.select("level", F.col("embedding").alias("va"))
        per = novelty.farthest(usable.select("level", F.col("node_id").alias("ib"), F.col("embedding").alias("vb")), proposal)
        members = graph.trajectory_members(chains, "ib").join(usable.select(F.col("node_id").alias("ib"), F.lit(1).alias("usable")), "ib", "left")
        dist = cut(novelty.trajectory_distances(members, per, proposal))
        best = novelty.nearest(novelty.weighted_total(dist, ["trajectory"])).first()
        if best is None:
            return {"novelty_score": 1.0, "most_similar_trajectory": None, "level_distances": {}, "divergence_points": [], "dimension_scores": {}, "recommendation": "There are no trajectories to compare with."}
        levels = {r["level"]: round(r["distance"], 6) for r in dist.where(F.col("trajectory") == best["trajectory"]).collect()}  # five rows
        chain = chains.where(F.col("w5") == best["trajectory"]).first().asDict()
        return {"novelty_score": best["score"], "most_similar_trajectory": chain, "distance": best["distance"], "level_distances": levels, **self._rubric(mine, atoms, chain, levels)}

    def _rubric(self, mine: DataFrame, atoms: DataFrame, chain: dict, levels: dict) -> dict:
        """The model's view of a proposal against one trajectory: divergence_points, dimension_scores, recommendation."""
        ids = self.spark.createDataFrame([(n,) for n in chain.values() if n], "node_id string")
        near = atoms.join(F.broadcast(ids), "node_id", "left_semi").select(F.lit("nearest").alias("side"), "level", "context")  # five rows
        both = near.unionByName(mine.select(F.lit("proposal").alias("side"), "level", "context"))
        lines = both.select(F.lit("x").alias("source"), F.struct("side", "level").alias("pos"), F.concat_ws(" ", "side", "level", "context").alias("text"))
        head = "\n".join(f"{k} distance {v:.4f}" for k, v in sorted(levels.items())) + "\n"
        asked = extract.prompts(lines, mark="\n").select("source", F.concat(F.lit(head), "prompt").alias("prompt"))
        said = providers.ask(asked, "source", self.model, task="rubric").first()
        try:
            reply = json.loads(said["reply"]) if said else {}
        except ValueError:
            reply = {}
        return {"divergence_points": reply.get("divergence_points", []), "dimension_scores": reply.get("dimension_scores", {}), "recommendation": reply.get("recommendation", "")}

    def consolidate(self) -> DataFrame:
        """Merges duplicates across sources, level by level; returns the report per level."""
        atoms, edges, since = self._held()
        a, e, rep = self._consolidated(atoms, edges)
        self.store.commit(a, e, since=since)
        return rep

    def audit(self, task_spec: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """Audits the active atoms and stores their new statuses; returns the report and the verdicts per atom."""
        atoms, edges, since = self._held()
        after, report, per = audit.verify(atoms, edges, model=self.model, spec=task_spec, catalogue=self.catalogue, k=self.config.audit_k)
        report, per = cut(report), cut(per)
        self.store.commit(after, edges, since=since)
        return report, per

    @staticmethod
    def schema() -> dict:
        """The ontology, as tools show it."""
        return {"types": O.TYPES, "levels": O.LEVELS, "level_aliases": O.LEVEL_ALIASES, "relations": O.HORIZONTAL, "hierarchy": O.HIERARCHY, "strong_causal": O.STRONG_CAUSAL, "categories": O.CATEGORIES, "checks": O.TYPE_CHECKS, "matrix": O.MATRIX}
