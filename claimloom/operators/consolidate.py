"""Consolidation: same-parent candidates, single-linkage clusters, merges and rewiring."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import providers
from claimloom.functions import json as J
from claimloom.ontology import LEVELS, TYPES, lookup
from claimloom.operators import extract
from claimloom.operators.graph import parents_at, weak_components
from claimloom.operators.vote import vote_nested
from claimloom.plans.lineage import cut, forget
from claimloom.plans.ship import ship
from claimloom.plans.skew import hot_from_counts, salted_join

#: Vectors of a group compared in one block; larger groups are compared by pairs of blocks.
BLOCK = 2_000
#: Rows of pairs of blocks that one call works off together.
PACK = 8_000
#: Rows of a block in one matrix product where only clusters are asked for.
CHUNK = 512
#: The group of all atoms of the top level, which have no parent.
ROOT = "__root__"


def candidates(atoms: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """(node_id, grp): live atoms of a level with their parent one level up; orphans left out, the top level is one group."""
    live = atoms.where((F.col("level") == level) & ~F.col("status").isin("merged", "transient"))
    if level == LEVELS[0]:
        return live.select("node_id", F.lit(ROOT).alias("grp"))
    return parents_at(edges, atoms, level, LEVELS[LEVELS.index(level) - 1]).join(live.select("node_id"), "node_id", "left_semi").withColumnRenamed("parent_id", "grp")


def similar_in_group(vectors: DataFrame, threshold: float) -> DataFrame:
    """(grp, a, b, cos): pairs a < b of one group with cosine >= threshold, from (grp, node_id, embedding).

    A group is cut into blocks of at most ``BLOCK`` vectors by a hash of the id and
    each pair of its blocks is one matrix product of its own, so a group of any size
    is spread; many small groups share a call.  Groups are the stated unit of
    comparison, and no pair leaves the task unless it passes.
    """
    sizes = cut(vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    total, tiled = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * parts), F.lit(0))).first()
    hot = hot_from_counts(sizes, ["grp"], "n", total)
    v = salted_join(vectors, sizes, ["grp"], total=total, hot=hot).select("grp", "node_id", "embedding", parts.alias("parts"), F.pmod(F.xxhash64("node_id"), parts).cast("int").alias("block"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    sent = v.select("grp", "node_id", "embedding", "block", F.explode(tiles).alias("t")).select("grp", "node_id", "embedding", "block", "t.i", "t.j")
    ship(vectors.sparkSession)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        m /= np.where(length == 0, 1.0, length)
        ids, block, first, second, grp = (pdf[c].to_numpy() for c in ("node_id", "block", "i", "j", "grp"))
        parts = []
        for at in pdf.groupby(["grp", "i", "j"], sort=False).indices.values():
            i, j = first[at[0]], second[at[0]]
            il, ir = at[block[at] == i], at[block[at] == j]
            cos = m[il] @ m[ir].T
            a, b = np.nonzero(cos >= threshold)
            x, y = ids[il[a]], ids[ir[b]]
            keep = x < y if i == j else x != y
            x, y, c = x[keep], y[keep], cos[a, b][keep]
            if len(x):
                parts.append(pd.DataFrame({"grp": grp[at[0]], "a": np.minimum(x, y), "b": np.maximum(x, y), "cos": c}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"grp": pd.Series(dtype=object), "a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "cos": pd.Series(dtype=float)})

    packs = max(1, tiled // PACK)  # rows as they are sent, once per pair of blocks
    packed = sent.withColumn("pack", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(packs)))
    return packed.groupBy("pack").applyInPandas(compare, "grp string, a string, b string, cos double")


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster, node_id): single linkage, i.e. components of the pairs; only clusters of two or more arise."""
    found = weak_components(pairs.select("a", "b").distinct())
    return found.select(F.col("component").alias("cluster"), "node_id")


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a[i]`` and ``b[i]`` in place; every entry of ``root`` is the smallest of its set."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _united(sent: DataFrame, threshold: float, whole: bool, rows: int) -> DataFrame:
    """(label, root, multi): labels that a tile's similar pairs join, with the smallest of them; labels that nothing joins are left out.

    ``sent``: (grp, multi, i, j, block, label, embedding), a row for each tile (i, j)
    that a vector is in, ``rows`` in all.  The vectors of block i, with ``whole`` all
    of the tile, are compared with those of block j; pairs of one label need no look.
    """
    ship(sent.sparkSession)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        m /= np.where(length == 0, 1.0, length)
        label, block, first, second, multi = (pdf[c].to_numpy() for c in ("label", "block", "i", "j", "multi"))
        labels, roots, multis = [], [], []
        for at in pdf.groupby(["grp", "i", "j"], sort=False).indices.values():
            names, code = np.unique(label[at], return_inverse=True)
            root = np.arange(len(names))
            here = block[at]
            right = np.flatnonzero(here == second[at[0]])
            left = np.arange(len(at)) if whole else np.flatnonzero(here == first[at[0]])
            to = m[at[right]].T
            for k in range(0, len(left), CHUNK):
                some = left[k : k + CHUNK]
                a, b = np.nonzero((m[at[some]] @ to >= threshold) & (root[code[some]][:, None] != root[code[right]]))
                _unite(root, code[some[a]], code[right[b]])
                if not root.any():
                    break
            joined = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
            labels.append(names[joined])
            roots.append(names[root[joined]])
            multis.append(np.full(len(joined), multi[at[0]]))
        return pd.DataFrame({"label": np.concatenate(labels), "root": np.concatenate(roots), "multi": np.concatenate(multis)})

    packs = max(1, rows // PACK)
    packed = sent.withColumn("pack", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(packs)))
    return packed.groupBy("pack").applyInPandas(compare, "label string, root string, multi boolean")


def clusters_in_groups(groups: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(cluster, node_id): what ``clusters`` makes of the pairs of ``similar_in_group``, without a row per pair.

    ``groups``: (node_id, grp), one row per atom; ``vectors``: (node_id, embedding),
    one row per atom.  Groups of up to ``BLOCK`` vectors are done in one call.  Of a
    larger group each block is compared with itself and with the first block; then
    what isn't in the group's largest cluster is compared with all of the group, so
    every pair is compared but those that are in one cluster already.  A call
    returns at most a row per vector.
    """
    sizes = cut(groups.join(vectors.select("node_id"), "node_id", "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    total, sent, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") + (parts - 1) * BLOCK), F.lit(0)), F.max(parts)).first()
    hot = hot_from_counts(sizes, ["grp"], "n", total)
    blocks = salted_join(groups.select("node_id", "grp"), sizes, ["grp"], hot=hot).select("grp", "node_id", parts.alias("parts"), F.pmod(F.xxhash64("node_id"), parts).cast("int").alias("block"))
    v = blocks.join(vectors.select("node_id", "embedding"), "node_id")
    tiles = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("block"))
    found = cut(_united(v.select("grp", (F.col("parts") > 1).alias("multi"), F.lit(0).alias("i"), F.explode(tiles).alias("j"), "block", F.col("node_id").alias("label"), "embedding"), threshold, True, sent))
    done = found.where("not multi").select(F.col("root").alias("cluster"), F.col("label").alias("node_id"))
    if not total or most == 1:
        return done
    joined = cut(weak_components(found.where("multi").select(F.col("label").alias("a"), F.col("root").alias("b"))))
    forms = v.where("parts > 1").select("grp", "node_id").join(joined, "node_id", "left").withColumn("label", F.coalesce("component", "node_id"))
    each = cut(forms)
    per = each.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n"))
    out = F.ceil((F.col("n") - F.col("n_top")) / BLOCK).cast("int")
    left = cut(per.where("n > n_top").select("grp", "top", out.alias("n_out"), F.ceil(F.col("n_top") / BLOCK).cast("int").alias("n_in"), "n", "n_top"))
    rows = left.agg(F.coalesce(F.sum((F.col("n") - F.col("n_top")) * (F.col("n_out") + F.col("n_in")) + F.col("n_top") * F.col("n_out")), F.lit(0))).first()[0]
    if rows:
        h = F.xxhash64("node_id")
        inside = F.col("label") == F.col("top")
        b = each.join(F.broadcast(left), "grp").select("grp", "node_id", "label", "n_out", "n_in", F.when(inside, F.col("n_out") + F.pmod(h, F.col("n_in"))).otherwise(F.pmod(h, F.col("n_out"))).cast("int").alias("block"))  # a row per group of more than BLOCK
        others = F.transform(F.sequence(F.lit(0), F.when(F.col("block") < F.col("n_out"), F.col("n_out") + F.col("n_in") - 1).otherwise(F.col("n_out") - 1)), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
        pairs = b.join(vectors.select("node_id", "embedding"), "node_id").select("grp", F.lit(True).alias("multi"), F.explode(others).alias("t"), "block", "label", "embedding")
        more = weak_components(_united(pairs.select("grp", "multi", "t.i", "t.j", "block", "label", "embedding"), threshold, False, rows).select(F.col("label").alias("a"), F.col("root").alias("b")))
        each = salted_join(each, more.select(F.col("node_id").alias("label"), F.col("component").alias("last")), ["label"], "left")
    else:
        each = each.withColumn("last", F.lit(None).cast("string"))
    return done.unionByName(each.where("component is not null or last is not null").select(F.coalesce("last", "label").alias("cluster"), "node_id"))


def rewire(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with duplicates replaced by their canonical atom at both ends; self loops dropped, keys once, attributes carried.

    ``mapping``: (dup_id, canonical_id), one row per dup_id.  All other columns are
    kept; of edges that become one, the first that wasn't moved gives weight, and the
    first that has any gives the evidence and the rest.
    """
    rest = [c for c in edges.columns if c not in ("src", "tgt", "relation", "weight")]
    s, t = mapping.select(F.col("dup_id").alias("src"), F.col("canonical_id").alias("ns")), mapping.select(F.col("dup_id").alias("tgt"), F.col("canonical_id").alias("nt"))
    out = salted_join(edges.join(s, "src", "left"), t, ["tgt"], "left").select(F.coalesce("ns", "src").alias("src"), F.coalesce("nt", "tgt").alias("tgt"), "relation", "weight", *rest, (F.col("ns").isNotNull() | F.col("nt").isNotNull()).alias("moved"))
    kept = out.where(F.col("src") != F.col("tgt"))
    order = F.coalesce("weight", F.lit(1.0))
    return kept.groupBy("src", "tgt", "relation").agg(F.min_by("weight", F.struct("moved", order)).alias("weight"), *[F.min_by(c, F.struct(F.col(c).isNull(), "moved", order, c)).alias(c) for c in rest], F.min("moved").alias("moved"))


def decide(cluster_rows: DataFrame, atoms: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(canonical_id, dup_id): decisions per cluster; the first member (smallest id) is canonical.

    ``judge`` may drop clusters: it gets (cluster, node_id) and returns the clusters to merge.
    """
    yes = cluster_rows if judge is None else cluster_rows.join(judge(cluster_rows).select("cluster"), "cluster", "left_semi")
    return yes.where(F.col("cluster") != F.col("node_id")).select(F.col("cluster").alias("canonical_id"), F.col("node_id").alias("dup_id"))


def canonical_type(raw: str = "raw_type", fallback: str = "type"):
    """Type of a decision, else of the first member, else method."""
    return F.when(F.col(raw).isin(TYPES), F.col(raw)).otherwise(F.coalesce(F.col(fallback), F.lit("method")))


def adjudicate(cluster_rows: DataFrame, atoms: DataFrame, model: providers.Model | None = None, k: int = 3) -> DataFrame:
    """Decisions of the model on clusters (cluster, node_id): (cluster, name, type, context) of those to be merged.

    The model is asked once per cluster with its atoms in order of their ids, as
    many as a prompt takes; each field is a vote of ``k`` replies.  An unknown type
    falls back to the first member's, a missing name or context too.
    """
    first = atoms.select(F.col("node_id").alias("cluster"), "name", "type", "context")
    rows = cluster_rows.join(atoms.select("node_id", "name", "type", "context"), "node_id")
    lines = rows.select(F.col("cluster").alias("source"), F.col("node_id").alias("pos"), F.to_json(F.struct("node_id", "name", "type", F.substring("context", 1, 400).alias("context"))).alias("text"))
    replies = providers.ask(extract.prompts(lines, mark="\n"), "source", model, k, "judge")
    said = replies.select(F.col("source").alias("cluster"), "sample", F.from_json("reply", "map<string,string>").alias("r")).where("r is not null")
    votes = vote_nested(said, ["cluster"], "r", [F.col("sample")])
    one = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    got = votes.groupBy("cluster").agg(one("merge").alias("merge"), one("canonical_name").alias("n"), one("canonical_type").alias("raw_type"), one("canonical_context").alias("c"))
    yes = got.where("merge = 'true'").join(first, "cluster")
    return yes.select("cluster", F.coalesce(F.nullif("n", F.lit("")), "name").alias("name"), canonical_type().alias("type"), F.coalesce(F.nullif("c", F.lit("")), "context").alias("context"))


def apply_merges(atoms: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms with canonical ones active and duplicates merged, and the rewired edges.

    ``decisions``: (canonical_id, dup_id) and, where the canonical atom is rewritten,
    name, type, context and parent.  ``merged_into`` and ``merged_from`` (sorted) keep
    the trace.  Where atoms have a provenance it also gets both, ``merged_from``
    united with an older list, the phase and the parent.
    """
    into = decisions.select(F.col("dup_id").alias("node_id"), F.col("canonical_id").alias("merged_into"))
    given = [c for c in ("name", "type", "context", "parent") if c in decisions.columns]
    frm = decisions.groupBy(F.col("canonical_id").alias("node_id")).agg(F.sort_array(F.collect_set("dup_id")).alias("merged_from"), *[F.max(c).alias(f"__{c}") for c in given])  # the atom's own trace
    out = atoms.join(into, "node_id", "left").join(frm, "node_id", "left")
    is_dup, is_canonical = F.col("merged_into").isNotNull(), F.col("merged_from").isNotNull()
    cols = {"status": F.when(is_dup, "merged").when(is_canonical, "active").otherwise(F.col("status"))}
    cols |= {c: F.coalesce(f"__{c}", c) for c in given if c != "parent"}
    if "provenance" in atoms.columns:
        old = J.strings(F.col("provenance"), "merged_from")
        both = F.array_distinct(F.concat(old, F.coalesce("merged_from", F.array().cast("array<string>"))))
        parent = F.nullif("__parent", F.lit(ROOT)) if "parent" in given else F.lit(None).cast("string")
        patch = F.to_json(F.struct(F.lit("consolidate").alias("phase"), "merged_into", F.when(is_canonical, both).alias("merged_from"), F.when(is_canonical, parent).alias("parent")))
        cols["provenance"] = F.when(is_dup | is_canonical, J.merged(F.col("provenance"), patch)).otherwise(F.col("provenance"))
    keep = [cols[c].alias(c) if c in cols else F.col(c) for c in atoms.columns]
    return out.select(*keep, "merged_into", "merged_from"), rewire(edges, decisions)


def _links_up(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, level, parent_id, prio): what ``parents_at`` chooses from, for the live atoms of all levels."""
    up = edges.where(F.col("relation") == "aggregates_to").select(F.col("src").alias("node_id"), F.col("tgt").alias("parent_id"), F.lit(0).alias("prio"))
    down = edges.where(F.col("relation") == "decomposes_into").select(F.col("tgt").alias("node_id"), F.col("src").alias("parent_id"), F.lit(1).alias("prio"))
    child = atoms.where(~F.col("status").isin("merged", "transient") & F.col("level").isin(LEVELS[1:])).select("node_id", "level")
    above = lookup(F.col("level"), dict(zip(LEVELS[:-1], LEVELS[1:], strict=True)))
    parent = atoms.where(F.col("level").isin(LEVELS[:-1])).select(F.col("node_id").alias("parent_id"), above.alias("child_level"))
    return salted_join(up.unionByName(down).join(child, "node_id"), parent, ["parent_id"]).where("level = child_level").select("node_id", "level", "parent_id", "prio")


def decisions(atoms: DataFrame, edges: DataFrame, vectors: DataFrame, threshold: float = 0.85, judge=None) -> tuple[list[DataFrame], DataFrame]:
    """What ``consolidate`` merges: a table per level from the top, as ``apply_merges`` takes them, and its report.

    An atom's parent is looked up among the merges of the level above, so nothing
    has to be rewired to find the groups of a level.  Of ``edges`` only the
    hierarchy's (src, tgt, relation) are read; ``vectors`` may have a level as well.
    """
    live = atoms.where(~F.col("status").isin("merged", "transient"))
    links = cut(_links_up(atoms, edges))
    if "level" not in vectors.columns:
        vectors = cut(vectors.join(atoms.where(F.col("level").isin(LEVELS)).select("node_id", "level"), "node_id"))
    picked, reports = [], []
    for level in LEVELS:
        if not picked:
            groups = live.where(F.col("level") == level).select("node_id", F.lit(ROOT).alias("grp"))
        else:
            moved = picked[-1].select(F.col("dup_id").alias("parent_id"), "canonical_id")
            now = salted_join(links.where(F.col("level") == level), moved, ["parent_id"], "left").select("node_id", "prio", F.coalesce("canonical_id", "parent_id").alias("grp"))
            groups = now.groupBy("node_id").agg(F.min(F.struct("prio", "grp")).alias("m")).select("node_id", F.col("m.grp").alias("grp"))
        groups = cut(groups)
        found = cut(clusters_in_groups(groups, vectors.where(F.col("level") == level), threshold))
        said = None if judge is None else cut(judge(found, atoms))
        picks = decide(found, atoms, None if said is None else lambda rows, said=said: said)
        if said is not None and "name" in said.columns:
            picks = picks.join(said.withColumnRenamed("cluster", "canonical_id"), "canonical_id")
            picks = picks.join(groups.select(F.col("node_id").alias("canonical_id"), F.col("grp").alias("parent")), "canonical_id", "left")
        picks = cut(picks)
        counts = found.agg(F.count(F.lit(1)).alias("n_candidates"), F.count_distinct("cluster").alias("n_clusters")).join(F.broadcast(picks.agg(F.count(F.lit(1)).alias("n_merged"))))  # one row each
        reports.append(counts.select(F.lit(level).alias("level"), "n_candidates", "n_clusters", "n_merged"))
        picked.append(picks)
    return picked, reduce(DataFrame.unionByName, reports)


def consolidate(atoms: DataFrame, edges: DataFrame, vectors: DataFrame, threshold: float = 0.85, judge=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All levels from the top; each level sees the rewiring of the one above.

    ``judge`` gets a level's clusters (cluster, node_id) and the atoms and returns
    decisions as ``adjudicate`` does, or only the clusters; without it every cluster
    is merged.  Returns atoms, edges and the report (level, n_candidates, n_clusters,
    n_merged).
    """
    picked, report = decisions(atoms, edges, vectors, threshold, judge)
    for i, picks in enumerate(picked):
        merged_atoms, rewired = apply_merges(atoms, edges, picks)
        last, (atoms, edges) = (atoms, edges), (cut(merged_atoms.drop("merged_into", "merged_from")), cut(rewired.drop("moved")))
        if i:
            forget(last[0])
            forget(last[1])
    return atoms, edges, report


def totals(report: DataFrame) -> DataFrame:
    """One row: atoms_merged, clusters_formed and levels_processed, the levels that had clusters, from the top."""
    order = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    had = F.sort_array(F.collect_list(F.when(F.col("n_clusters") > 0, F.struct(order.alias("o"), "level"))))  # five at most
    return report.agg(F.sum("n_merged").alias("atoms_merged"), F.sum("n_clusters").alias("clusters_formed"), F.transform(had, lambda x: x["level"]).alias("levels_processed"))
