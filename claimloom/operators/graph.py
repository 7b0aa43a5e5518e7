"""Graph operators: personalised PageRank, components, traversals, trajectories."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.ontology import HIERARCHY, LEVELS
from claimloom.plans.lineage import cut, forget
from claimloom.plans.ship import ship
from claimloom.plans.skew import hot_from_counts, salted_join

#: Rounds of PageRank; with damping 0.5 the rest is below 0.5 ** ROUNDS, a thousandth of the sixth digit.
ROUNDS = 30
#: Graphs of at most so many edges are ranked in one task, larger ones by joins; both give the same scores.
ONE_TASK_EDGES = 2_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected graph as arcs in both directions: no loops, repeated edges once."""
    e = edges.where(F.col("src") != F.col("tgt"))
    return e.select("src", "tgt").unionByName(e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()


def _rank(src: np.ndarray, tgt: np.ndarray, n: int, reset: np.ndarray, damping: float, rounds: int) -> np.ndarray:
    """Power iteration for all columns of ``reset`` at once; mass of dead ends returns to the reset."""
    degree = np.bincount(src, minlength=n).astype(float)
    dead = degree == 0
    p = reset.copy()
    order = np.argsort(tgt, kind="stable")
    s, t = src[order], tgt[order]
    heads = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, int)
    for _ in range(rounds):
        got = np.zeros_like(p)
        if len(t):
            got[t[heads]] = np.add.reduceat((p[s].T / degree[s]).T, heads, axis=0)
        p = (1 - damping) * reset + damping * (got + p[dead].sum(axis=0) * reset)
    return p


def pagerank(arcs: DataFrame, reset: DataFrame, damping: float = 0.5, rounds: int = ROUNDS, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node_id, score): PageRank on distinct directed arcs (src, tgt), restarting by ``reset`` (node_id, r).

    ``reset`` is normalised to sum 1.  Mass of nodes without out-arcs returns to the
    reset.  A fixed number of rounds makes the result reproducible.  Graphs of at
    most ``one_task_edges`` arcs and seeds go to one task as arrays; larger ones take one
    join and one aggregation per round, partitioned by node, with the lineage cut
    each round and very frequent sources salted.  Nodes that no score reaches are
    left out.
    """
    total = reset.agg(F.sum("r").alias("t"))
    r0 = reset.groupBy("node_id").agg(F.sum("r").alias("r")).join(F.broadcast(total)).select("node_id", (F.col("r") / F.col("t")).alias("r"))  # one row
    n_arcs = arcs.count()
    if n_arcs + reset.count() <= one_task_edges:
        return _pagerank_one_task(arcs, r0, damping, rounds)
    degree = arcs.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    hot = hot_from_counts(degree.withColumnRenamed("node_id", "src"), ["src"], "degree", n_arcs)
    r0 = cut(r0)
    degree = cut(degree)
    p = r0.withColumnRenamed("r", "p")
    for _ in range(rounds):
        known = p.join(degree, "node_id", "left")
        dead = known.where("degree is null").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("dead"))
        give = known.where("degree is not null").select(F.col("node_id").alias("src"), (F.col("p") / F.col("degree")).alias("give"))
        got = salted_join(arcs, give, ["src"], "inner", total=n_arcs, hot=hot).groupBy(F.col("tgt").alias("node_id")).agg(F.sum("give").alias("got"))
        both = got.join(r0, "node_id", "full_outer").join(F.broadcast(dead))  # one row
        g, r = F.coalesce("got", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
        p = cut(both.select("node_id", ((1 - damping) * r + damping * (g + F.col("dead") * r)).alias("p")))
    return p.where("p > 0").select("node_id", F.col("p").alias("score"))


def _pagerank_one_task(arcs: DataFrame, reset: DataFrame, damping: float, rounds: int) -> DataFrame:
    ship(arcs.sparkSession)
    rows = arcs.select("src", "tgt", F.lit(None).cast("double").alias("r")).unionByName(reset.select(F.col("node_id").alias("src"), F.lit(None).cast("string").alias("tgt"), "r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat([*batches, pd.DataFrame({"src": [], "tgt": [], "r": []})], ignore_index=True)
        edge = all_["tgt"].notna()
        names = pd.Index(pd.unique(pd.concat([all_["src"], all_.loc[edge, "tgt"]])))
        if len(names):
            reset_ = np.zeros((len(names), 1))
            np.add.at(reset_[:, 0], names.get_indexer(all_.loc[~edge, "src"]), all_.loc[~edge, "r"].to_numpy(float))
            p = _rank(names.get_indexer(all_.loc[edge, "src"]), names.get_indexer(all_.loc[edge, "tgt"]), len(names), reset_, damping, rounds)[:, 0]
            yield pd.DataFrame({"node_id": names, "score": p})[p > 0]

    return rows.coalesce(1).mapInPandas(run, "node_id string, score double")


def weak_components(links: DataFrame) -> DataFrame:
    """(node_id, component): smallest id of the weakly connected component, for every node of ``links`` (a, b).

    Each round every node takes the smallest label among its neighbours and then
    the label of its label; the lineage is cut each round.  Smallest labels are
    combined before the shuffle, so a hub is no hot spot; lookups of hubs are salted.
    """
    arcs = cut(links.select(F.col("a").alias("node_id"), F.col("b").alias("n")).unionByName(links.select(F.col("b").alias("node_id"), F.col("a").alias("n"))).distinct())
    total = arcs.count()
    labels = cut(arcs.groupBy("node_id").agg(F.least(F.min("n"), F.first("node_id")).alias("component")))
    hot = hot_from_counts(arcs.groupBy("n").agg(F.count(F.lit(1)).alias("k")), ["n"], "k", total)
    while total:
        seen = salted_join(arcs, labels.select(F.col("node_id").alias("n"), F.col("component").alias("c")), ["n"], "inner", total=total, hot=hot)
        best = seen.groupBy("node_id").agg(F.min("c").alias("c"))
        mine = labels.join(best, "node_id", "left").select("node_id", F.least("component", "c").alias("c"), F.col("component").alias("old"))
        jump = mine.select(F.col("node_id").alias("c"), F.col("c").alias("cc"))
        nxt = cut(salted_join(mine, jump, ["c"], "left", total=total).select("node_id", F.least("c", "cc").alias("component"), "old"))
        forget(labels)
        labels = nxt
        if nxt.where(F.col("component") != F.col("old")).isEmpty():
            break
        labels = nxt.select("node_id", "component")
    return labels.select("node_id", "component")


def components_by_level(edges: DataFrame, atoms: DataFrame, level: str, mode: str = "weak") -> DataFrame:
    """(node_id, component) of the subgraph that a level's atoms induce; single atoms are their own component.

    ``mode='strong'`` asks for strong components: trimmed by repeated forward and
    backward smallest-label passes inside the weak components.
    """
    mine = atoms.where(F.col("level") == level).select("node_id")
    inside = edges.join(mine.withColumnRenamed("node_id", "src"), "src", "left_semi").join(mine.withColumnRenamed("node_id", "tgt"), "tgt", "left_semi")
    arcs = inside.where(F.col("src") != F.col("tgt")).select("src", "tgt").distinct()
    found = weak_components(arcs.select(F.col("src").alias("a"), F.col("tgt").alias("b"))) if mode == "weak" else strong_components(arcs)
    return mine.join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def _reach_min(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, low): smallest id from which each node is reached along the arcs, itself included."""
    labels = cut(nodes.select("node_id", F.col("node_id").alias("low")))
    while True:
        sent = arcs.join(labels.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("tgt").alias("node_id")).agg(F.min("low").alias("m"))
        nxt = cut(labels.join(sent, "node_id", "left").select("node_id", F.least("low", "m").alias("low"), F.col("low").alias("old")))
        if nxt.where("low <> old").isEmpty():
            return nxt.select("node_id", "low")
        labels = nxt.select("node_id", "low")


def strong_components(arcs: DataFrame) -> DataFrame:
    """(node_id, component): strong components, named by their smallest id.

    Colouring: forward smallest labels split the graph by colour; within a colour the
    nodes that reach its root backwards form one component and leave; the rest goes on.
    """
    arcs = cut(arcs)
    left = cut(arcs.select(F.col("src").alias("node_id")).unionByName(arcs.select(F.col("tgt").alias("node_id"))).distinct())
    done = None
    while not left.isEmpty():
        colour = _reach_min(arcs, left)
        c1, c2 = colour.select(F.col("node_id").alias("src"), F.col("low").alias("l1")), colour.select(F.col("node_id").alias("tgt"), F.col("low").alias("l2"))
        same = cut(arcs.join(c1, "src").join(c2, "tgt").where("l1 = l2").select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
        back = _reach_min(same, left)
        part = cut(colour.join(back.withColumnRenamed("low", "b"), "node_id").where(F.col("low") == F.col("b")).select("node_id", F.col("low").alias("component")))
        done = part if done is None else done.unionByName(part)
        left = cut(left.join(part, "node_id", "left_anti"))
        arcs = cut(arcs.join(left.withColumnRenamed("node_id", "src"), "src", "left_semi").join(left.withColumnRenamed("node_id", "tgt"), "tgt", "left_semi"))
    return done if done is not None else left.select("node_id", F.col("node_id").alias("component"))


def upward_trace(edges: DataFrame, atoms: DataFrame, starts: DataFrame, target_level: str) -> DataFrame:
    """(start, step, node_id): the way up along aggregates_to, heaviest edge first, until the target level or a dead end.

    At most one edge per node is followed (highest weight, then smallest id), no
    loops.  A way that comes back to a node it has visited ends before it.
    """
    up = edges.where((F.col("relation") == "aggregates_to") & (F.col("src") != F.col("tgt"))).groupBy(F.col("src").alias("node_id")).agg(F.min(F.struct((-F.coalesce("weight", F.lit(1.0))).alias("w"), F.col("tgt"))).alias("m")).select("node_id", F.col("m.tgt").alias("nxt"))
    stop = atoms.where(F.col("level") == target_level).select("node_id")
    up = cut(up.join(stop, "node_id", "left_anti"))
    front = cut(starts.select(F.col("node_id").alias("start"), F.lit(0).alias("step"), "node_id").distinct())
    seen, parts = front, [front]
    while True:
        nxt = front.join(up, "node_id").select("start", (F.col("step") + 1).alias("step"), F.col("nxt").alias("node_id"))
        front = cut(nxt.join(seen, ["start", "node_id"], "left_anti").select("start", "step", "node_id"))
        if front.isEmpty():
            return seen
        parts.append(front)
        if len(parts) % 16 == 0:  # keeps the plan small on long ways
            parts = [cut(reduce(DataFrame.unionByName, parts))]
        seen = reduce(DataFrame.unionByName, parts)


def downward_expand(edges: DataFrame, atoms: DataFrame, starts: DataFrame, target_level: str) -> DataFrame:
    """(start, node_id): all reached along decomposes_into, start included; nodes of the target level are not expanded.

    A frontier loop: each round is one join, and what was reached before is removed,
    until nothing new is reached.
    """
    down = cut(edges.where(F.col("relation") == "decomposes_into").select("src", "tgt").distinct())
    stop = atoms.where(F.col("level") == target_level).select(F.col("node_id").alias("src"))
    down = cut(down.join(stop, "src", "left_anti"))
    front = cut(starts.select(F.col("node_id").alias("start"), "node_id").distinct())
    parts = [front]
    while True:
        seen = reduce(DataFrame.unionByName, parts)
        nxt = front.join(down, front["node_id"] == down["src"]).select("start", F.col("tgt").alias("node_id")).distinct()
        front = cut(nxt.join(seen, ["start", "node_id"], "left_anti"))
        if front.isEmpty():
            return seen
        parts.append(front)
        if len(parts) % 16 == 0:  # keeps the plan small on deep trees
            parts = [cut(reduce(DataFrame.unionByName, parts))]


#: Ranking from seeds goes on until what is still to come is at most this part of a score.
REST = 1e-10
#: Pairs of seed and node that one task ranks at once, unless a single seed has more.
PAIRS_AT_ONCE = 2_000_000


def _rank_reached(src: np.ndarray, tgt: np.ndarray, n: int, seeds: np.ndarray, damping: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index into seeds, node, score) of every node each seed reaches, iterated until the scores stand."""
    order = np.argsort(src, kind="stable")
    t = tgt[order]
    degree = np.bincount(src, minlength=n)
    first = np.r_[0, np.cumsum(degree)]

    def arcs_of(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``nodes`` and target of every arc out of them."""
        d = degree[nodes]
        at = np.repeat(np.arange(len(nodes)), d)
        return at, t[np.repeat(first[nodes] - np.r_[0, np.cumsum(d)[:-1]], d) + np.arange(d.sum())] if len(nodes) else t[:0]

    todo = [np.arange(len(seeds))]
    while todo:
        mine = todo.pop()
        if not len(mine):
            continue
        # a pair is its seed's place in ``mine`` times n, plus the node
        start = np.arange(len(mine)) * n + seeds[mine]
        pairs = front = start
        while len(front) and (len(pairs) <= PAIRS_AT_ONCE or len(mine) == 1):
            at, to = arcs_of(front % n)
            front = np.setdiff1d(front[at] // n * n + to, pairs)
            pairs = np.union1d(pairs, front)
        if len(front):  # too many at once
            todo += [mine[len(mine) // 2 :], mine[: len(mine) // 2]]
            continue
        at, to = arcs_of(pairs % n)
        into = np.searchsorted(pairs, pairs[at] // n * n + to)
        give = damping / degree[pairs[at] % n]
        reset = np.zeros(len(pairs))
        reset[np.searchsorted(pairs, start)] = 1 - damping
        p = reset
        while True:
            nxt = reset + np.bincount(into, p[at] * give, minlength=len(pairs))
            if ((nxt - p <= REST * (1 - damping) * nxt).all() and (nxt > 0).all()) or np.array_equal(nxt, p):
                break
            p = nxt
        yield mine[pairs // n], pairs % n, nxt


def _ranks_one_task(arcs: DataFrame, seeds: DataFrame, damping: float) -> DataFrame:
    ship(arcs.sparkSession)
    rows = arcs.select("src", "tgt").unionByName(seeds.select(F.col("node_id").alias("src"), F.lit(None).cast("string").alias("tgt")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat([*batches, pd.DataFrame({"src": [], "tgt": []}, dtype=object)], ignore_index=True)
        edge = all_["tgt"].notna()
        names = pd.Index(pd.unique(pd.concat([all_["src"], all_.loc[edge, "tgt"]])))
        seed = names.get_indexer(all_.loc[~edge, "src"])
        for s, x, p in _rank_reached(names.get_indexer(all_.loc[edge, "src"]), names.get_indexer(all_.loc[edge, "tgt"]), len(names), seed, damping):
            for i in range(0, len(s), 100_000):
                w = slice(i, i + 100_000)
                yield pd.DataFrame({"seed": names[seed[s[w]]], "node_id": names[x[w]], "p": p[w]})

    return rows.coalesce(1).mapInPandas(run, "seed string, node_id string, p double")


def _ranks_by_joins(arcs: DataFrame, seeds: DataFrame, damping: float) -> DataFrame:
    degree = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    out = cut(arcs.join(degree, "src"))
    start = cut(seeds.select(F.col("node_id").alias("seed"), "node_id").withColumn("p", F.lit(1 - damping)))
    p, reached, quiet = start, start.count(), 0
    while damping**quiet > REST:
        got = p.join(out.withColumnRenamed("src", "node_id"), "node_id").select("seed", F.col("tgt").alias("node_id"), (damping * F.col("p") / F.col("degree")).alias("p"))
        nxt = cut(got.unionByName(start).groupBy("seed", "node_id").agg(F.sum("p").alias("p")))
        if p is not start:
            forget(p)
        p, before, reached = nxt, reached, nxt.count()
        quiet = quiet + 1 if reached == before else 0
    return p


def best_ancestors(edges: DataFrame, atoms: DataFrame, seeds: DataFrame, level: str, damping: float = 0.5, one_task_edges: int = ONE_TASK_EDGES, relations: list[str] | None = HIERARCHY) -> DataFrame:
    """(seed, node_id, score): for every seed the best-ranked atom of a level by PageRank from the seed.

    All seeds are ranked at once on the directed graph, as rows keyed by seed and
    node, until no seed reaches a new node and the scores stand to ten digits; mass
    that leaves a seed's reach is not kept.  Only edges of ``relations`` carry rank
    (None: all).  Hierarchy edges alone keep each seed's rows as few as its relatives;
    with all edges a seed reaches most of the graph, which suits few seeds.  Scores are compared by their first
    digits, however small, so far ancestors are ranked too; ties go to the smaller
    id.  Graphs of at most ``one_task_edges`` arcs are ranked in one task.
    """
    carry = F.lit(True) if relations is None else F.col("relation").isin(relations)
    arcs = cut(edges.where(carry & (F.col("src") != F.col("tgt"))).select("src", "tgt").distinct())
    from_ = seeds.select("node_id").distinct()
    p = (_ranks_one_task if arcs.count() <= one_task_edges else _ranks_by_joins)(arcs, from_, damping)
    of_level = atoms.where(F.col("level") == level).select("node_id")
    best = Window.partitionBy("seed").orderBy(F.round(F.log("p"), 8).desc(), "node_id")
    return p.join(of_level, "node_id").withColumn("n", F.row_number().over(best)).where("n = 1").select("seed", "node_id", F.round("p", 6).alias("score"))


def parents_at(edges: DataFrame, atoms: DataFrame, child_level: str, parent_level: str) -> DataFrame:
    """(node_id, parent_id): hierarchy neighbour exactly at the parent level; aggregates_to first, then smallest id."""
    up = edges.where(F.col("relation") == "aggregates_to").select(F.col("src").alias("node_id"), F.col("tgt").alias("parent_id"), F.lit(0).alias("prio"))
    down = edges.where(F.col("relation") == "decomposes_into").select(F.col("tgt").alias("node_id"), F.col("src").alias("parent_id"), F.lit(1).alias("prio"))
    child = atoms.where(F.col("level") == child_level).select("node_id")
    parent = atoms.where(F.col("level") == parent_level).select(F.col("node_id").alias("parent_id"))
    cand = up.unionByName(down).join(child, "node_id", "left_semi").join(parent, "parent_id", "left_semi")
    return cand.groupBy("node_id").agg(F.min(F.struct("prio", "parent_id")).alias("m")).select("node_id", F.col("m.parent_id").alias("parent_id"))


def trajectory_members(chains: DataFrame, name: str = "node_id") -> DataFrame:
    """(trajectory, level, ``name``): the atoms of each trajectory, which is named by its code atom."""
    steps = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(f"w{i + 1}").alias(name)) for i, lv in enumerate(LEVELS)])
    return chains.select(F.col("w5").alias("trajectory"), F.explode(steps).alias("x")).select("trajectory", "x.*").where(F.col(name).isNotNull())


def trajectories(edges: DataFrame, atoms: DataFrame, statuses: list[str], damping: float = 0.5) -> DataFrame:
    """(w5, w4, w3, w2, w1): from every code atom of the given statuses its best ancestor at each level, at any distance.

    Each step starts from the ancestor of the step before (``best_ancestors``); a
    level that isn't reached ends the chain.
    """
    out = atoms.where((F.col("level") == LEVELS[4]) & F.col("status").isin(statuses)).select(F.col("node_id").alias("w5"))
    for i in range(4, 0, -1):
        below = out.where(F.col(f"w{i + 1}").isNotNull()).select(F.col(f"w{i + 1}").alias("node_id")).distinct()
        step = cut(best_ancestors(edges, atoms, below, LEVELS[i - 1], damping)).select(F.col("seed").alias(f"w{i + 1}"), F.col("node_id").alias(f"w{i}"))
        out = cut(out.join(step, f"w{i + 1}", "left"))
    return out.select("w5", "w4", "w3", "w2", "w1")
