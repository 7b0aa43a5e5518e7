import random

import pytest

from claimloom.operators import hierarchy as H


def brute(parent):
    out = {}
    for n in parent:
        up, at = [n], parent[n]
        while at is not None and at not in up:
            up.append(at)
            at = parent[at]
        if at is None:
            out[n] = (up[-1], len(up) - 1)
        else:
            out[n] = (min(up[up.index(at) :]), -1)
    return out


def edges(spark, parent):
    return spark.createDataFrame([(p, c, "decomposes_into") for c, p in parent.items() if p is not None], "src string, tgt string, relation string")


def shapes(seed):
    """Random trees, chains, combs, and cycles with things below them."""
    r = random.Random(seed)
    parent = {"t0": None}
    for i in range(1, 80):
        parent[f"t{i}"] = f"t{r.randrange(i)}"
    parent |= {"c0": None} | {f"c{i}": f"c{i - 1}" for i in range(1, 40)}
    parent |= {"k0": None} | {f"k{i}": f"k{i - 1}" for i in range(1, 30)} | {f"kl{i}": f"k{i}" for i in range(30)}
    for size in (1, 2, 3, 11):
        parent |= {f"r{size}_{i}": f"r{size}_{(i + 1) % size}" for i in range(size)}
        parent |= {f"b{size}_{i}": r.choice([f"r{size}_{j}" for j in range(size)] + [f"b{size}_{j}" for j in range(i)]) for i in range(12)}
    return parent


@pytest.mark.parametrize(("seed", "tail"), [(1, 0), (2, 40), (3, 10_000)])
def test_any_shape_against_brute_force(spark, monkeypatch, seed, tail):
    monkeypatch.setattr(H, "TAIL", tail)
    parent = shapes(seed)
    want = brute(parent)
    full = {r["node_id"]: r for r in H.hierarchy(edges(spark, parent), with_path=True).collect()}
    assert {n: (r["root_id"], r["tree_depth"]) for n, r in full.items()} == want
    plain = {r["node_id"]: (r["root_id"], r["tree_depth"], r["height"], r["subtree_size"]) for r in H.hierarchy(edges(spark, parent)).collect()}
    assert plain == {n: (r["root_id"], r["tree_depth"], r["height"], r["subtree_size"]) for n, r in full.items()}
    size, height = {}, {}
    for n, r in full.items():
        if r["path"] is None:
            assert want[n][1] == -1 and r["height"] is None and r["subtree_size"] is None
            continue
        assert r["path"][-1] == n and all(parent[c] == p for p, c in zip(r["path"], r["path"][1:], strict=False))
        assert parent[r["path"][0]] is None or full[r["path"][0]]["path"] is None
        for k, x in enumerate(reversed(r["path"])):
            size[x], height[x] = size.get(x, 0) + 1, max(height.get(x, 0), k)
    for n, r in full.items():
        if r["path"] is not None:
            assert (r["subtree_size"], r["height"]) == (size[n], height[n])


def test_chain_of_5000(spark):
    parent = {"n00000": None} | {f"n{i:05}": f"n{i - 1:05}" for i in range(1, 5000)}
    got = {r["node_id"]: r for r in H.hierarchy(edges(spark, parent)).collect()}
    assert len(got) == 5000 and all(r["tree_depth"] == int(n[1:]) and r["subtree_size"] == 5000 - int(n[1:]) for n, r in got.items())


def test_a_cycle_of_300(spark, monkeypatch):
    monkeypatch.setattr(H, "TAIL", 0)
    parent = {f"n{i:03}": f"n{(i + 1) % 300:03}" for i in range(300)} | {"low": "n150"}
    assert {(r["root_id"], r["tree_depth"]) for r in H.roots_and_depths(edges(spark, parent)).collect()} == {("n000", -1)}


def test_links_left_out_are_listed(spark, rows):
    e = spark.createDataFrame([("p2", "c", "decomposes_into"), ("c", "p1", "aggregates_to"), ("p1", "d", "decomposes_into")], "src string, tgt string, relation string")
    assert rows(H.other_parents(e)) == [("c", "p2", "p1")]
