"""Most similar vectors for every vector (problem 2): a permutation index with pivot inverted files.

Every vector is represented by its nearest pivots in order.  It is posted in the
inverted files of the first few of them.  Files that grow too large are split by
pivots of their own until they fit.  Within a file, every vector is compared with all
others by their true cosine; on request only with the best by the footrule distance
of their pivot orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.plans.lineage import cut
from claimloom.plans.ship import ship
from claimloom.plans.skew import hot_from_counts, salted_join

#: Vectors that the pivots are taken from: a bounded sample, as the pivots are too.
SAMPLE = 20_000
MIN_PIVOTS, MAX_PIVOTS = 16, 2048
#: Vectors for which there is one pivot more.
PER_PIVOT = 200
#: Length of a vector's order of pivots, and in how many files it is posted.
ORDER, POSTINGS = 12, 4
#: Files beyond this are split by pivots of their own until they fit.
FILE = 4_000
#: Most pivots of one split file, and in how many of its parts a vector is posted.
LOCAL_PIVOTS, LOCAL_POSTINGS = 32, 3
#: Postings that one task works off, so that tasks stay as large however many vectors there are.
TASK = 40_000


def unit_rows(values: np.ndarray) -> np.ndarray:
    return values / np.linalg.norm(values.astype(np.float64), axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): rows whose vector has ``dim`` finite numbers, not all zero; v is the unit vector as float32 bytes."""
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    ship(vectors.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("v")
            flat = col.flatten()
            m = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, dtype=np.float32).reshape(-1, dim)
            ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
            ids = b.column("id").filter(pa.array(ok))
            u = unit_rows(m[ok]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), pa.array([r.tobytes() for r in u], pa.binary())], ["id", "v"])

    return rows.mapInArrow(check, "id string, v binary")


def _pivots(distinct: DataFrame, n: int, dim: int) -> np.ndarray:
    """Pivots: a bounded number of the ``n`` distinct vectors (k, v), chosen by their hash, so alike in every run."""
    want = int(min(MAX_PIVOTS, max(MIN_PIVOTS, n // PER_PIVOT), max(n, 1)))
    bar = int(min(1.0, 2.0 * want / max(n, 1)) * 2**31)
    first = lambda rows: rows.orderBy(F.xxhash64("v", F.lit(1)), "v").select("v").limit(min(want, SAMPLE)).collect()
    some = first(distinct.where(F.pmod("k", F.lit(2**31)) <= bar))
    if len(some) < want:  # the hash left too few
        some = first(distinct)
    return np.stack([np.frombuffer(r[0], dtype=np.float32) for r in some]) if some else np.zeros((0, dim), np.float32)


def _within(near: np.ndarray, p: np.ndarray, to: np.ndarray, reach: float) -> np.ndarray:
    """For each vector which of its nearest pivots ``to`` it is to be posted at.

    ``near`` is larger for nearer pivots, its differences being those of half the
    squared distances.  A neighbour within ``reach`` whose nearest pivot is another
    one than the vector's lies beyond the plane halfway between the two; so a pivot
    behind a plane farther away than that needs no posting.
    """
    held = np.take_along_axis(near, to, 1)
    apart = np.linalg.norm(p[to] - p[to[:, :1]], axis=2)
    return held[:, :1] - held <= reach * apart + 1e-6


def _orders(units: DataFrame, pivots: np.ndarray, order: int, postings: int, reach: float) -> DataFrame:
    """(k, v, perm, post): each distinct vector with its nearest pivots, nearest first, and those it is posted at."""
    sent = units.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors
    length = min(order, len(pivots))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value.T.copy()
        for b in batches:
            v = b.column("v")
            m = np.frombuffer(b"".join(v.to_pylist()), dtype=np.float32).reshape(len(v), -1)
            out = np.empty((len(m), length), np.int16)
            use = np.zeros((len(m), min(postings, length)), bool)
            for i in range(0, len(m), 2048):
                near = m[i : i + 2048] @ p
                top = np.argpartition(-near, length - 1, axis=1)[:, :length] if length < near.shape[1] else np.tile(np.arange(length), (len(near), 1))
                out[i : i + 2048] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
                use[i : i + 2048] = _within(near, sent.value, out[i : i + 2048, : use.shape[1]], reach)
            perm = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, length, dtype=np.int32)), pa.array(out.reshape(-1)))
            post = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(use.sum(axis=1))].astype(np.int32)), pa.array(out[:, : use.shape[1]][use]))
            yield pa.RecordBatch.from_arrays([b.column("k"), v, perm, post], ["k", "v", "perm", "post"])

    return units.mapInArrow(rank, "k bigint, v binary, perm array<smallint>, post array<smallint>")


def _postings(orders: DataFrame) -> DataFrame:
    """(file, k, v, perm): each vector once per file it is posted in."""
    return orders.select(F.explode(F.col("post").cast("array<bigint>")).alias("file"), "k", "v", "perm")


def _local_pivots(files: DataFrame) -> DataFrame:
    """(file, n, i, v): pivots of each large file, from its own vectors by hash, at most ``LOCAL_PIVOTS``."""
    mix = F.xxhash64("k", "file")
    share = F.least(F.lit(1.0), 4.0 * LOCAL_PIVOTS / F.col("n"))
    some = files.select("file", "k", "v", "n").where(F.pmod(mix, F.lit(2**31)) <= (share * 2**31).cast("bigint"))
    first = some.withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy(mix, "k"))).where(F.col("i") <= LOCAL_PIVOTS)
    return first.where(F.col("i") <= F.greatest(F.lit(4.0), F.ceil(2.0 * LOCAL_POSTINGS * F.col("n") / FILE))).select("file", "n", F.col("i").cast("bigint").alias("i"), "v")


def _split(files: DataFrame, pivots: DataFrame, total: int, reach: float) -> DataFrame:
    """The large ``files``, each vector posted at its nearest of the file's own pivots.

    Vectors and pivots of a file meet in tasks of bounded size: a file of any size is
    spread over salts, its pivots go to each of them and come first, so that a task
    holds one file's pivots at a time.
    """
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / TASK)).cast("int")
    rows = files.select("file", F.pmod(F.xxhash64("k", F.lit(3)), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "k", "v", "perm", F.col("n").alias("was"))
    lead = pivots.select("file", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("i").alias("k"), "v", F.lit(None).cast("array<smallint>").alias("perm"), F.col("n").alias("was"))
    both = lead.unionByName(rows).repartition(1 + total // TASK, "file", "salt").sortWithinPartitions("file", "salt", "kind", "k")
    ship(files.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = None, []
        for b in batches:
            file, salt, kind = (np.asarray(b.column(c)) for c in ("file", "salt", "kind"))
            v = b.column("v")
            m = np.frombuffer(b"".join(v.to_pylist()), dtype=np.float32).reshape(len(v), -1)
            ends = np.flatnonzero((np.diff(file) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(v)], strict=True) if len(v) else []:
                here = (int(file[lo]), int(salt[lo]))
                if here != at:
                    at, pivots = here, []
                if kind[lo] == 0:
                    pivots += list(m[lo:hi])
                    continue
                # seen from their middle, as vectors of one file may differ by little
                p = np.stack(pivots)
                mid = p.mean(axis=0)
                p = p - mid
                near = (m[lo:hi] - mid) @ p.T - (p * p).sum(axis=1) / 2
                to = np.argsort(-near, axis=1, kind="stable")[:, :LOCAL_POSTINGS].astype(np.int32)
                use = _within(near, p, to, reach)
                each = b.slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), use.sum(axis=1))))
                names = ["file", "k", "v", "perm", "was"]
                yield pa.RecordBatch.from_arrays([pa.array(to[use]), *(each.column(c) for c in names)], ["part", *names])

    parts = both.mapInArrow(post, "part int, file bigint, k bigint, v binary, perm array<smallint>, was bigint")
    return parts.select(F.xxhash64("file", "part").alias("file"), "k", "v", "perm", "was")


def _in_blocks(files: DataFrame) -> DataFrame:
    """Files (with their size n) that pivots don't split, as one file for every two of their blocks, so that all vectors still meet."""
    blocks = F.ceil(2 * F.col("n") / FILE)
    mine = files.select("file", "k", "v", "perm", blocks.alias("blocks"), F.pmod(F.xxhash64("k", F.lit(2)), blocks).alias("a"))
    mine = mine.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return mine.select(F.xxhash64("file", F.lit("block"), F.least("a", "b"), F.greatest("a", "b")).alias("file"), "k", "v", "perm")


def _fitting(files: DataFrame, reach: float) -> DataFrame:
    """``files`` with those of more than ``FILE`` vectors split, over and over, until all fit.

    A part that holds more than three quarters of the file it comes from isn't split
    by pivots again, but in blocks of which each meets each.  No list of files or
    pivots reaches the driver or is sent to all workers; joins with the large files
    are salted by their sizes.
    """
    keep = ["file", "k", "v", "perm"]
    files, done = files.withColumn("was", F.lit(None).cast("bigint")), []
    while True:
        over = cut(files.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("was").alias("was")).where(F.col("n") > FILE))
        total = over.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not total:
            return reduce(DataFrame.unionByName, [*done, files.select(*keep)])
        hot = hot_from_counts(over, ["file"], "n", total)
        done.append(salted_join(files.select(*keep), over.select("file"), ["file"], "left_anti", total=total, hot=hot))
        pick = lambda of, files=files, total=total, hot=hot: salted_join(files.select(*keep), of.select("file", "n"), ["file"], "inner", total=total, hot=hot)
        split = over.where(F.col("was").isNull() | (F.col("n") <= 0.75 * F.col("was")))
        pivots = cut(_local_pivots(pick(split)))
        enough = pivots.groupBy("file").agg(F.count(F.lit(1)).alias("p")).where("p > 1").select("file")
        done.append(_in_blocks(pick(over.join(enough, "file", "left_anti"))))
        files = cut(_split(pick(split.join(enough, "file", "left_semi")), pivots.join(enough, "file", "left_semi"), total, reach))


def nearest_in_file(keys: np.ndarray, vecs: np.ndarray, perms: np.ndarray, k: int, min_cos: float, rerank: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector of a file its ``k`` nearest of the file by cosine.

    With ``rerank``, only so many nearest by footrule are compared, and all that tie
    with the last of them.
    """
    n, length = perms.shape
    if rerank is not None:
        local, flat = np.unique(perms, return_inverse=True)
        flat = flat.reshape(n, length)
        # weight[p, x]: length minus the place of pivot p in x's order, 0 if it isn't there
        weight = np.zeros((len(local), n), np.uint8)
        weight[flat, np.arange(n)[:, None]] = np.arange(length, 0, -1, dtype=np.uint8)
    qs, rs, cs = [], [], []
    step = max(1, 2_000_000 // max(n, 1))
    for i in range(0, n, step):
        rows = np.arange(i, min(i + step, n))
        cos = vecs[rows] @ vecs.T
        if rerank is not None and rerank < n - 1:
            # footrule distance = 2 * (sum of 1..length - shared); the more is shared, the nearer
            shared = np.zeros((len(rows), n), np.int16)
            for j in range(length):
                shared += np.minimum(weight[flat[rows, j]], np.uint8(length - j))
            shared[np.arange(len(rows)), rows] = -1
            cos[shared < np.partition(shared, n - rerank, axis=1)[:, n - rerank, None]] = -2
        cos[np.arange(len(rows)), rows] = -2
        low = np.full(len(rows), min_cos - 1e-5, np.float32)
        many = np.flatnonzero((cos >= low[0]).sum(axis=1) > k)
        if len(many):  # the k best, and what the precision can't tell from the last of them
            low[many] = np.maximum(low[many], np.partition(cos[many], n - k, axis=1)[:, n - k] - 2e-6)
        q, r = np.nonzero(cos >= low[:, None])
        if not len(q):
            continue
        true = np.concatenate([np.einsum("ij,ij->i", vecs[rows[q[a : a + 50_000]]].astype(np.float64), vecs[r[a : a + 50_000]].astype(np.float64)) for a in range(0, len(q), 50_000)])
        by = np.lexsort((keys[r], -true, q))
        q, r, true = q[by], r[by], true[by]
        heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        best = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)])) < k
        qs.append(keys[rows[q[best]]])
        rs.append(keys[r[best]])
        cs.append(true[best])
    if not qs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(qs), np.concatenate(rs), np.concatenate(cs)


def _work_off(postings: DataFrame, tasks: int, k: int, min_cos: float, rerank: int | None) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        keys = np.asarray(table.column("k").combine_chunks(), dtype=np.int64)
        perms = np.asarray(table.column("perm").combine_chunks().flatten(), dtype=np.int16).reshape(len(keys), -1)
        keys, at = np.unique(keys, return_index=True)
        perms = perms[at]
        if len(keys) < 2:
            return pa.table({"q": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        raw = table.column("v").to_pylist()
        vecs = np.frombuffer(b"".join([raw[i] for i in at]), dtype=np.float32).reshape(len(keys), -1)
        q, r, c = nearest_in_file(keys, vecs, perms, k, min_cos, rerank)
        return pa.table({"q": q, "r": r, "cos": c})

    return postings.repartition(tasks, "file").groupBy("file").applyInArrow(one, "q bigint, r bigint, cos double")


def most_similar(vectors: DataFrame, *, id_col: str = "node_id", vec_col: str = "embedding", dim: int = 64, k: int = 5, min_cos: float = -1.0, postings: int = POSTINGS, order: int = ORDER, rerank: int | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): for every id its ``k`` most similar others of at least ``min_cos``.

    Usable are vectors of ``dim`` finite numbers that are not all zero; rows with
    other vectors (null, empty, other length, NaN) are left out.  An id with several
    rows counts once; if their vectors differ, each counts for it.  Ids with the same
    vector are indexed once, so any number of copies makes no hot file; they are each
    other's nearest.  Ties go to the smaller id.  Fewer than two usable ids give no
    rows.

    Approximate: a neighbour is missed if it shares no file with the vector or, if
    ``rerank`` is given, is not among so many best by footrule in any (ties with the
    last of them are compared too).  The pivots are a bounded sample
    (at most ``MAX_PIVOTS``); every vector is indexed.
    """
    ids = usable(vectors, id_col, vec_col, dim).select("id", "v", F.xxhash64("v").alias("k"))
    ship(vectors.sparkSession)
    distinct = ids.select("k", "v").dropDuplicates(["k"])
    members = cut(ids.select("k", "id").distinct())
    n_members = members.count()
    n_distinct = members.select("k").distinct().count()
    pivots = _pivots(distinct, n_distinct, dim)
    if n_members < 2:
        return members.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)
    reach = float(np.sqrt(max(0.0, 2 - 2 * min_cos)))  # between unit vectors of that cosine
    orders = cut(_orders(distinct, pivots, order, postings, reach))
    n_posted = orders.agg(F.coalesce(F.sum(F.size("post")), F.lit(0))).first()[0]
    near = _work_off(_fitting(_postings(orders), reach), 1 + LOCAL_POSTINGS * n_posted // TASK, k, min_cos, rerank)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cos").desc(), "r"))
    top = near.dropDuplicates(["q", "r"]).withColumn("n", rank).where(F.col("n") <= k).select("q", "r", "cos")
    # the ids that may stand for a vector: its k + 1 smallest
    few = members.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id"))).where(F.col("n") <= k + 1).select("k", F.col("id").alias("neighbour"))
    same = few.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("q"), F.col("k").alias("r"), F.lit(1.0).alias("cos"))
    offers = top.unionByName(same).join(few.withColumnRenamed("k", "r"), "r")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cos").desc(), "neighbour"))
    offers = offers.withColumn("n", best).where(F.col("n") <= 2 * k + 1).select(F.col("q").alias("k"), "neighbour", "cos")
    mine = salted_join(members, offers, ["k"], "inner", total=n_members).where(F.col("id") != F.col("neighbour"))
    mine = mine.groupBy("id", "neighbour").agg(F.max("cos").alias("cosine"))
    final = F.row_number().over(Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour"))
    return mine.withColumn("rank", final).where(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")


def similar_pairs(vectors: DataFrame, *, min_cos: float = 0.9, k: int = 5, **named) -> DataFrame:
    """(node_a, node_b): pairs of at least ``min_cos`` where either is among the other's ``k`` most similar."""
    near = most_similar(vectors, k=k, min_cos=min_cos, **named).where(F.col("cosine") >= min_cos)
    return near.select(F.least("id", "neighbour").alias("node_a"), F.greatest("id", "neighbour").alias("node_b")).distinct()
