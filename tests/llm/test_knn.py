import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import knn

SCHEMA = "node_id string, embedding array<float>, k int, v string"


def data(spark, pairs):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 0, "") for i, v in pairs], SCHEMA)


def truth(pairs, k, low):
    ids = [i for i, _ in pairs]
    m = np.array([v for _, v in pairs])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = m @ m.T
    out = set()
    for a in range(len(ids)):
        near = sorted((-round(c[a, b], 9), ids[b]) for b in range(len(ids)) if b != a and c[a, b] >= low)[:k]
        out |= {(min(ids[a], b), max(ids[a], b)) for _, b in near}
    return out


def clusters(seed, n_centres=60, per=6, noise=0.12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n_centres, 64))
    return [(f"n{i:02}_{j}", c[i] * rng.uniform(0.5, 3) + noise * rng.normal(size=64)) for i in range(n_centres) for j in range(per)] + [(f"z{i:03}", rng.normal(size=64)) for i in range(300)]


def test_recall_against_brute_force(spark):
    pairs = clusters(1)
    got = {tuple(r) for r in knn.similar_pairs(data(spark, pairs)).collect()}
    want = truth(pairs, 5, 0.9)
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_split_files_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(knn, "FILE", 40)
    pairs = clusters(2)
    want = truth(pairs, 5, 0.9)
    got = {tuple(r) for r in knn.similar_pairs(data(spark, pairs)).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_unusable_vectors_copies_and_repeated_rows(spark, rows):
    one, two = np.ones(64), np.r_[np.ones(32), -np.ones(32)]
    bad = [("b1", None), ("b2", []), ("b3", [1.0] * 32), ("b4", [0.0] * 64), ("b5", [float("nan")] + [1.0] * 63), ("b6", [float("inf")] + [1.0] * 63)]
    copies = [(f"c{i}", one) for i in range(9)] + [("c0", one), ("far", two)]
    got = rows(knn.similar_pairs(data(spark, copies + bad)))
    want = truth([p for p in copies if p[0] != "c0"] + [("c0", one)], 5, 0.9)
    assert set(got) == want
    scaled = knn.most_similar(data(spark, [("a", one), ("b", 3 * one), ("c", two)]), k=1)
    assert {(r["id"], r["neighbour"]) for r in scaled.collect()} >= {("a", "b"), ("b", "a")}


def test_few_rows(spark, rows):
    assert rows(knn.similar_pairs(data(spark, []))) == []
    assert rows(knn.similar_pairs(data(spark, [("a", np.ones(64))]))) == []


def test_footrule_is_what_ranks():
    perms = np.array([[0, 1, 2], [1, 0, 2], [5, 6, 7]], np.int16)
    vecs = np.eye(3, 4, dtype=np.float32)
    vecs[1] = vecs[2] = vecs[0]
    q, r, c = knn.nearest_in_file(np.array([10, 11, 12]), vecs, perms, k=1, min_cos=-1, rerank=1)
    assert dict(zip(q.tolist(), r.tolist(), strict=True))[10] == 11 and c[0] == pytest.approx(1.0)


def test_recall_when_four_ids_hold_each_vector(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(1500, 64))
    vecs = [(f"{i:04}{j}", c + 0.2 * rng.normal(size=64)) for i, c in enumerate(centres) for j in range(2)]
    held = [(f"{i}_{c}", v) for i, v in vecs for c in range(4)]
    # k = 7: the three copies, then the four of the other vector
    got = {(a[:5], b[:5]) for a, b in knn.similar_pairs(data(spark, held), k=7).collect() if a[:5] != b[:5]}
    want = truth(vecs, 1, 0.9)
    assert len(want) > 1000 and len(got & want) / len(want) >= 0.95


def dense(n, others):
    """A cluster of mean cosine 0.97 among others, with the indices of each member's five nearest."""
    rng = np.random.default_rng(5)
    c = rng.normal(size=64)
    pairs = [(f"d{i:04}", c + 0.17 * rng.normal(size=64)) for i in range(n)] + [(f"z{i:04}", rng.normal(size=64)) for i in range(others)]
    return pairs, truth(pairs, 5, 0.9)


def test_recall_in_a_cluster_of_a_third(spark):
    pairs, want = dense(1200, 2400)
    got = {tuple(r) for r in knn.similar_pairs(data(spark, pairs)).collect()}
    assert len(got & want) / len(want) >= 0.95


def test_files_that_pivots_do_not_split_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "FILE", 100)
    monkeypatch.setattr(knn, "_local_pivots", lambda files: files.select("file", "n", F.lit(1).cast("bigint").alias("i"), "v").limit(0))
    pairs, want = dense(300, 100)
    got = {tuple(r) for r in knn.similar_pairs(data(spark, pairs), postings=1, order=1).collect()}
    monkeypatch.setattr(knn, "FILE", 4000)
    whole = {tuple(r) for r in knn.similar_pairs(data(spark, pairs), postings=1, order=1).collect()}
    assert got == whole


def test_splits_through_several_levels_and_salts(spark, monkeypatch):
    monkeypatch.setattr(knn, "FILE", 30)
    monkeypatch.setattr(knn, "TASK", 100)
    monkeypatch.setattr(knn, "PER_PIVOT", 1000)
    pairs = clusters(3)
    want = truth(pairs, 5, 0.9)
    got = {tuple(r) for r in knn.similar_pairs(data(spark, pairs)).collect()}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95
