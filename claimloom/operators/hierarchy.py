"""Parent-child links to full hierarchies (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from claimloom.functions.text import present
from claimloom.ontology import relation_letters
from claimloom.plans.lineage import cut, forget
from claimloom.plans.ship import ship
from claimloom.plans.skew import hot_from_counts, salted_join

#: So many tables of nodes that are done are written together, so that plans stay short.
GATHER = 8
#: What is left after peeling to so few nodes is peeled off in one task, instead of in rounds of a few nodes each.
TAIL = 1_000


def _child_parent(edges: DataFrame) -> DataFrame:
    """(node, parent) of each hierarchy edge, and (parent, null) for its parent."""
    letters = relation_letters(F.col("relation"))
    e = edges.where(present(F.col("src")) & present(F.col("tgt"))).select(letters.alias("r"), "src", "tgt").where(F.col("r").isin("decomposesinto", "aggregatesto"))
    down = F.col("r") == "decomposesinto"
    child, parent = F.when(down, F.col("tgt")).otherwise(F.col("src")), F.when(down, F.col("src")).otherwise(F.col("tgt"))
    both = F.array(F.struct(child.alias("node"), parent.alias("parent")), F.struct(parent.alias("node"), F.lit(None).cast("string").alias("parent")))
    return e.select(F.explode(both).alias("x")).select("x.node", "x.parent")


def parent_links(edges: DataFrame) -> DataFrame:
    """(node, parent) of every id in a hierarchy edge, parent null at a root.

    ``decomposes_into`` points from parent to child, ``aggregates_to`` from child to
    parent, however they are spelled; edges with a null or blank endpoint are left
    out.  Of several parents the smallest is kept, so that the links form trees
    and cycles.
    """
    return _child_parent(edges).groupBy("node").agg(F.min("parent").alias("parent"))


def other_parents(edges: DataFrame) -> DataFrame:
    """(node_id, parent_id, kept_parent): the links that ``parent_links`` leaves out, as their node has a smaller parent too."""
    e = _child_parent(edges).where(F.col("parent").isNotNull()).distinct()
    kept = e.groupBy("node").agg(F.min("parent").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("node", "kept")
    return e.join(kept, "node").where(F.col("parent") != F.col("kept")).select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.col("kept").alias("kept_parent"))


class _Round(NamedTuple):
    """What one round of peeling removed."""

    n_nodes: int
    leaves: DataFrame
    spliced: DataFrame | None


def _heads(c: str, k: int) -> Column:
    """A coin for each id in round ``k``, the same whenever it is thrown."""
    return F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(2)) == 1


def peel(links: DataFrame, *, with_path: bool = False, tail: int | None = None) -> tuple[list[_Round], DataFrame]:
    """Leaf peeling from below, with chains contracted.

    Each round removes the nodes whose children are all removed and sends their
    subtree sizes and heights to their parents (combined before the shuffle, so a
    parent of a third of all nodes is no hot spot).  Of the nodes that are left with
    one child, some of which no two are neighbours are then taken out, so that their
    child hangs from their parent; their sizes wait on the link.  So a tree of any
    shape, a chain too, is gone after rounds in the order of the logarithm of its
    size, and each round only writes what is still there.  A cycle shrinks to a node
    that is its own parent.  The rounds end when only such nodes are left, or at most
    ``tail`` of any kind (by default ``TAIL``), which one task works off.

    Returns the rounds and what is known of the nodes left, as ``assign`` gives it.
    """
    tail = TAIL if tail is None else tail
    kids = links.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("pending"))
    # the link to the parent has e_...: size, height (from the parent) and smallest id of the nodes taken out of it
    link = [F.lit(1).alias("steps"), F.coalesce("pending", F.lit(0)).alias("pending"), F.lit(1).cast("long").alias("size"), F.lit(0).alias("height"), F.lit(0).cast("long").alias("e_size"), F.lit(-1).alias("e_height"), F.lit(None).cast("string").alias("e_min")]
    path = ["e_path"] if with_path else []
    left = cut(links.join(kids, "node", "left").select("node", "parent", *link, *[F.array().cast("array<string>").alias(c) for c in path]))
    total, rounds, open_ = left.count(), [], 1
    while total > tail and open_:
        k = len(rounds)
        leaves = left.where("pending = 0")
        mail = leaves.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") + F.col("e_size")).alias("s"), F.max(F.greatest(F.col("height") + F.col("steps"), "e_height")).alias("h"))
        after = left.where("pending > 0").join(mail, "node", "left").withColumns({"pending": F.col("pending") - F.coalesce("n", F.lit(0)), "size": F.col("size") + F.coalesce("s", F.lit(0)), "height": F.greatest("height", "h")}).drop("n", "s", "h")
        goes = F.coalesce((F.col("pending") == 1) & (F.col("parent") != F.col("node")) & _heads("node", k) & ~_heads("parent", k), F.lit(False))
        gone = after.where(goes).select(F.col("node").alias("parent"), F.col("parent").alias("up"), *[F.col(c).alias(f"u_{c}") for c in ("steps", "size", "height", "e_size", "e_height", "e_min", *path)])
        many = hot_from_counts(left.select(F.col("node").alias("parent"), F.col("pending").alias("n")), ["parent"], "n", total)
        both = salted_join(after.where(~goes), gone, ["parent"], "left", total=total, hot=many)
        took = F.col("up").isNotNull()
        record = F.struct(F.col("parent").alias("node"), F.col("up").alias("parent"), F.col("u_steps").alias("steps"), F.col("u_size").alias("size"), F.col("u_height").alias("height"), F.col("node").alias("child"), F.col("steps").alias("c_steps"), F.col("e_size").alias("c_e_size"), F.col("e_height").alias("c_e_height"), *[F.col(f"u_{c}").alias(c) for c in path])
        nxt = both.select(
            "node",
            F.coalesce("up", "parent").alias("parent"),
            (F.col("steps") + F.coalesce("u_steps", F.lit(0))).alias("steps"),
            "pending",
            "size",
            "height",
            (F.col("e_size") + F.coalesce(F.col("u_size") + F.col("u_e_size"), F.lit(0))).alias("e_size"),
            F.greatest(F.when(F.col("e_height") >= 0, F.col("e_height") + F.coalesce("u_steps", F.lit(0))).otherwise(-1), F.col("u_height") + F.col("u_steps"), "u_e_height").alias("e_height"),
            F.least("e_min", F.when(took, F.col("parent")), "u_e_min").alias("e_min"),
            *[F.when(took, F.concat("u_e_path", F.array("parent"), "e_path")).otherwise(F.col("e_path")).alias(c) for c in path],
            F.when(took, record).alias("record"),
        )
        seen = Observation()
        nxt = cut(nxt.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("parent").isNull() | (F.col("parent") != F.col("node"))).alias("open"), F.count("record").alias("spliced")))
        now, open_, n_spliced = (seen.get[c] for c in ("n", "open", "spliced"))
        rounds.append(_Round(total, leaves.select("node", "parent", "steps", "size", "height", *path), nxt.where("record is not null").select("record.*") if n_spliced else None))
        left, total = nxt.drop("record"), now
    if total <= tail:
        return rounds, cut(_tail(left, with_path))
    none = lambda kind: F.lit(None).cast(kind)
    cycles = [F.least("node", "e_min").alias("root"), F.lit(0).alias("depth"), F.lit(True).alias("ring"), F.lit(True).alias("cyclic"), none("long").alias("size"), none("int").alias("height")]
    return rounds, left.select("node", *cycles, *[F.array("node").alias("path") for _ in path])


def _tail(left: DataFrame, with_path: bool) -> DataFrame:
    """The last nodes of ``peel`` (at most ``TAIL``) as ``assign`` gives them, in one task."""
    schema = "node string, root string, depth int, ring boolean, cyclic boolean, size bigint, height int" + (", path array<string>" if with_path else "")
    ship(left.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = {r.node: r for b in batches for r in b.itertuples()}
        out: dict[str, dict] = {}
        order: list[str] = []  # parents before children
        for start in rows:
            way: list[str] = []
            at = start
            while at is not None and at not in out and at not in way:
                way.append(at)
                at = rows[at].parent
            if at is not None and at not in out:  # the way has come back to itself
                ring = way[way.index(at) :]
                label = min([*ring, *[rows[x].e_min for x in ring if rows[x].e_min is not None]])
                for x in ring:
                    out[x] = {"node": x, "root": label, "depth": 0, "ring": True, "cyclic": True, "size": None, "height": None, "path": [x]}
                way = way[: way.index(at)]
            for x in reversed(way):
                r, up = rows[x], out.get(rows[x].parent)
                out[x] = {"node": x, "root": up["root"] if up else x, "depth": up["depth"] + r.steps if up else 0, "ring": False, "cyclic": bool(up and up["cyclic"]), "size": r.size, "height": r.height}
                out[x]["path"] = [*up["path"], *r.e_path, x] if with_path and up else [x]
                order.append(x)
        for x in reversed(order):
            r, up = rows[x], out.get(rows[x].parent)
            if up and not up["ring"]:
                up["size"] += out[x]["size"] + r.e_size
                up["height"] = max(up["height"], out[x]["height"] + r.steps, r.e_height)
        if out:
            made = pd.DataFrame(list(out.values()))
            yield made.astype({"size": "Int64", "height": "Int32"})[[c.split()[0] for c in schema.split(", ")]]

    return left.coalesce(1).mapInPandas(run, schema)


def assign(rounds: list[_Round], last: DataFrame, *, with_path: bool = False) -> DataFrame:
    """Roots, depths and paths in reverse peel order, from what ``peel`` returned.

    A node was removed before its parent, so from the last round to the first the
    parent of each node is known when its turn comes; of a node that was taken out
    of a chain also the child, whose subtree completes its own.  Lookups of parents
    are salted, as one may have a third of all nodes.

    Columns: node, root, depth, ring (on a cycle), cyclic (on or below one), size,
    height and path, which begins at a root or on a cycle.  On and below a cycle the
    root is the smallest id on it.
    """
    path = ["path"] if with_path else []
    parts = [last]

    def known(as_: str, *cols: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).select(F.col("node").alias(as_), *[F.col(c).alias(f"{as_[0]}_{c}") for c in cols])

    def add(df: DataFrame) -> None:
        parts.append(cut(df))
        if len(parts) >= GATHER:
            old = parts[:]
            parts[:] = [cut(reduce(DataFrame.unionByName, old))]
            for df in old[1:]:
                forget(df)

    for done in reversed(rounds):
        if done.spliced is not None:
            s = done.spliced.join(known("child", "ring", "root", "size", "height"), "child")
            s = salted_join(s, known("parent", "root", "depth", "cyclic", *path), ["parent"], "inner", total=done.n_nodes)
            ring = F.col("c_ring")
            add(
                s.select(
                    "node",
                    F.when(ring, F.col("c_root")).otherwise(F.col("p_root")).alias("root"),
                    (F.col("p_depth") + F.col("steps")).alias("depth"),
                    ring.alias("ring"),
                    (ring | F.col("p_cyclic")).alias("cyclic"),
                    F.when(~ring, F.col("size") + F.col("c_e_size") + F.col("c_size")).alias("size"),
                    F.when(~ring, F.greatest("height", "c_e_height", F.col("c_height") + F.col("c_steps"))).alias("height"),
                    *[F.when(ring, F.array("node")).otherwise(F.concat("p_path", "e_path", F.array("node"))).alias(c) for c in path],
                )
            )
        r = salted_join(done.leaves, known("parent", "root", "depth", "cyclic", *path), ["parent"], "left", total=done.n_nodes)
        top = F.col("parent").isNull()
        add(
            r.select(
                "node",
                F.coalesce("p_root", "node").alias("root"),
                F.when(top, 0).otherwise(F.col("p_depth") + F.col("steps")).alias("depth"),
                F.lit(False).alias("ring"),
                F.coalesce("p_cyclic", F.lit(False)).alias("cyclic"),
                "size",
                "height",
                *[F.when(top, F.array("node")).otherwise(F.concat("p_path", "e_path", F.array("node"))).alias(c) for c in path],
            )
        )
    return reduce(DataFrame.unionByName, parts)


def hierarchy(edges: DataFrame, *, with_path: bool = False) -> DataFrame:
    """Root, depth, height and subtree size of every id in a hierarchy edge; cycles marked.

    Columns: node_id, root_id, tree_depth, height, subtree_size and, on request,
    path (ids from the root to the node).  On and below a cycle, root_id is the
    smallest id on the cycle and tree_depth -1; nodes on a cycle have no height,
    size or path (null), nodes below one have the path from the cycle.

    An id with several parents keeps the smallest (``other_parents`` lists the
    rest); a self loop is a cycle of one; repeated edges and the two spellings of a
    link count once; null and blank endpoints and null relations are left out; no
    hierarchy edges give no rows.
    """
    links = cut(parent_links(edges))
    info = assign(*peel(links))
    if with_path:
        # paths only run over links between trees, so that none grows around a cycle
        rings = cut(info.where("ring").select("node", F.col("root").alias("label")))
        trees = cut(links.join(rings, "node", "left").select("node", F.when(F.col("label").isNull(), F.col("parent")).alias("parent")))
        info = assign(*peel(trees, with_path=True), with_path=True).drop("ring", "cyclic")
        own, above = rings.select("node", F.col("label").alias("own")), rings.select(F.col("node").alias("root"), F.col("label").alias("top"))
        n = links.count()
        info = salted_join(info.join(own, "node", "left"), above, ["root"], "left", total=n)
        ring = F.col("own").isNotNull()
        info = info.select("node", F.coalesce("top", "root").alias("root"), "depth", F.col("top").isNotNull().alias("cyclic"), *[F.when(~ring, F.col(c)).alias(c) for c in ("size", "height", "path")])
    depth = F.when(F.col("cyclic"), -1).otherwise(F.col("depth")).alias("tree_depth")
    return info.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), depth, "height", F.col("size").alias("subtree_size"), *(["path"] if with_path else []))


def roots_and_depths(edges: DataFrame) -> DataFrame:
    """node_id, root_id and tree_depth as in ``hierarchy``."""
    return hierarchy(edges).select("node_id", "root_id", "tree_depth")


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, node_id, steps) for every node and each id above it on its path.

    Expanded from each node's own path, so no task holds a whole subtree.
    """
    at = F.posexplode("path")
    rows = paths.where(F.col("path").isNotNull()).select("node_id", F.size("path").alias("n"), at.alias("i", "ancestor"))
    return rows.where(F.col("ancestor") != F.col("node_id")).select("ancestor", "node_id", (F.col("n") - 1 - F.col("i")).alias("steps"))
