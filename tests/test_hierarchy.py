from claimloom.operators import hierarchy as H

SCHEMA = "src string, tgt string, relation string, note string, node string"


def edges(spark, rows):
    return spark.createDataFrame([(*r, "x", "clash") for r in rows], SCHEMA)


def test_trees_cycles_and_spellings(spark, rows):
    e = edges(
        spark,
        [
            ("a", "b", "decomposes_into"), ("b", "a", "AGGREGATES-TO"), ("b", "c", "Decomposes into "), ("d", "c", "aggregates_to"), ("d", "c", "aggregates_to"),
            ("x", "y", "decomposes_into"), ("y", "x", "decomposes_into"), ("y", "z", "decomposes_into"), ("z", "w", "decomposes_into"),
            ("s", "s", "aggregates_to"), ("a", None, "decomposes_into"), ("a", " ", "decomposes_into"), ("a", "q", "extends"), ("a", "r", None),
        ],
    )
    assert rows(H.roots_and_depths(e)) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("s", "s", -1), ("w", "x", -1), ("x", "x", -1), ("y", "x", -1), ("z", "x", -1)]
    full = {r["node_id"]: r for r in H.hierarchy(e, with_path=True).collect()}
    assert full["a"]["subtree_size"] == 4 and full["a"]["height"] == 3
    assert full["d"]["path"] == ["a", "b", "c", "d"]
    assert full["w"]["path"] == ["y", "z", "w"] and full["w"]["tree_depth"] == -1
    assert full["x"]["path"] is None and full["x"]["subtree_size"] is None
    down = rows(H.descendants(H.hierarchy(e, with_path=True).where("tree_depth >= 0")))
    assert ("a", "d", 3) in down and len(down) == 6


def test_several_parents_take_the_smallest(spark, rows):
    e = edges(spark, [("p2", "c", "decomposes_into"), ("p1", "c", "decomposes_into")])
    assert ("c", "p1", 1) in rows(H.roots_and_depths(e))


def test_empty(spark, rows):
    assert rows(H.hierarchy(edges(spark, []), with_path=True)) == []


def test_deep_chain_and_wide_parent(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}", "decomposes_into") for i in range(25)]
    wide = [("n000", f"k{i:04}", "decomposes_into") for i in range(500)]
    got = {r["node_id"]: r["tree_depth"] for r in H.roots_and_depths(edges(spark, chain + wide)).collect()}
    assert got["n025"] == 25 and got["k0499"] == 1 and len(got) == 526


def test_descendants_below_a_cycle(spark, rows, tmp_path):
    from claimloom.queries import core

    e = edges(spark, [("x", "y", "decomposes_into"), ("y", "x", "decomposes_into"), ("y", "z", "decomposes_into"), ("z", "w", "decomposes_into")])
    e.write.parquet(str(tmp_path / "cc_edges.parquet"))
    assert rows(core.p3_descendants(spark, str(tmp_path))) == [("y", "w", 2), ("y", "z", 1), ("z", "w", 1)]
