import os

import numpy as np
import pytest

from claimloom import ontology as O
from claimloom.operators import consolidate
from claimloom.plans.lineage import ensure_checkpoint_dir

V = "grp string, node_id string, embedding array<double>"


@pytest.mark.parametrize("threshold", [-1.0, 0.7, 0.9, 1.1])
def test_clusters_without_pairs_equal_those_of_the_pairs(spark, rows, monkeypatch, threshold):
    """Groups of one, of one block and of many; dense, sparse and empty."""
    monkeypatch.setattr(consolidate, "BLOCK", 7)
    monkeypatch.setattr(consolidate, "PACK", 40)
    monkeypatch.setattr(consolidate, "CHUNK", 3)
    rng = np.random.default_rng(3)
    made = [(g, f"{g}{i:03}", rng.normal(size=5).tolist()) for g, n in (("a", 90), ("b", 40), ("c", 7), ("d", 2), ("e", 1)) for i in rng.permutation(n)]
    made += [("b", "zero", [0.0] * 5), ("c", "x", [1.0, 0.0, 0.0, 0.0, 0.0]), ("c", "y", [1.0, 0.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(made, V)
    groups = v.select("node_id", "grp").union(spark.createDataFrame([("bare", "a"), ("bare2", "f")], "node_id string, grp string"))
    got = consolidate.clusters_in_groups(groups, v.select("node_id", "embedding"), threshold)
    assert rows(got) == rows(consolidate.clusters(consolidate.similar_in_group(v, threshold)))


def test_no_atoms(spark, rows):
    v = spark.createDataFrame([], V)
    assert rows(consolidate.clusters_in_groups(v.select("node_id", "grp"), v.select("node_id", "embedding"), 0.5)) == []


def _size(path):
    return sum(os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(path) for f in fs)


def test_a_dense_top_level_leaves_no_row_per_pair(spark, rows):
    """3,000 atoms of which all are alike are 4.5 million pairs; tables written must stay in proportion to the atoms."""
    n = 3_000
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(n, 8)) * 0.1 + 1
    ids = [f"atom-{i:05}" for i in rng.permutation(n)]
    a = spark.createDataFrame([(x, x, "problem", O.LEVELS[0], "", "active") for x in ids], "node_id string, name string, type string, level string, context string, status string")
    e = spark.createDataFrame([], "src string, tgt string, relation string, weight double")
    v = spark.createDataFrame(list(zip(ids, vectors.tolist(), strict=True)), "node_id string, embedding array<double>")
    at = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = _size(at)
    report = consolidate.consolidate(a, e, v, 0.2)[2]
    assert rows(report)[0] == (O.LEVELS[0], n, 1, n - 1)
    assert _size(at) - before < 3_000_000


def test_children_of_merged_parents_are_compared(spark, rows):
    """Parents p and q merge, so their children stand in one group; r keeps its own, and transient children are left out."""
    atoms = [("p", 0, "active"), ("q", 0, "active"), ("r", 0, "active"), ("p1", 1, "active"), ("q1", 1, "active"), ("r1", 1, "active"), ("q2", 1, "transient"), ("p11", 2, "active"), ("q11", 2, "active")]
    a = spark.createDataFrame([(n, n, "method", O.LEVELS[i], "", s) for n, i, s in atoms], "node_id string, name string, type string, level string, context string, status string")
    e = spark.createDataFrame([("p1", "p", "aggregates_to", 1.0), ("q", "q1", "decomposes_into", 1.0), ("r", "r1", "decomposes_into", 1.0), ("q2", "q", "aggregates_to", 1.0), ("p1", "p11", "decomposes_into", 1.0), ("q11", "q1", "aggregates_to", 1.0), ("q11", "p", "aggregates_to", 1.0)], "src string, tgt string, relation string, weight double")
    v = spark.createDataFrame([(n, [0.0, 1.0] if n == "r" else [1.0, 0.0]) for n, _, _ in atoms], "node_id string, embedding array<double>")
    after, edges, report = consolidate.consolidate(a, e, v, 0.9)
    assert rows(report) == [(O.LEVELS[0], 2, 1, 1), (O.LEVELS[1], 2, 1, 1), (O.LEVELS[2], 2, 1, 1), (O.LEVELS[3], 0, 0, 0), (O.LEVELS[4], 0, 0, 0)]
    assert {r["node_id"] for r in after.where("status = 'merged'").collect()} == {"q", "q1", "q11"}
    assert ("p1", "p", "aggregates_to", 1.0) in rows(edges) and ("p11", "p1", "aggregates_to", 1.0) in rows(edges) and ("p", "p1", "decomposes_into", 1.0) in rows(edges)
