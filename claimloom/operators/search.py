"""Search: dense recall, restart weights, PageRank over the undirected graph, filter and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.vectors import dot, softmax
from claimloom.operators.graph import ROUNDS, pagerank, undirected
from claimloom.ontology import LEVEL_ALIASES


def dense_recall(vectors: DataFrame, query, k: int) -> DataFrame:
    """(node_id, score): the ``k`` largest dot products with the query vector; ties to the smaller id."""
    return vectors.select("node_id", F.round(dot(F.col("embedding"), query), 9).alias("score")).orderBy(F.col("score").desc(), "node_id").limit(k)


def restart_weights(vectors: DataFrame, code_vectors: DataFrame, q_atom, q_code, k: int = 10, bias: float = 0.05) -> DataFrame:
    """(node_id, r): softmax over the recalled atoms plus a small softmax over all code atoms, summed to 1 by PageRank."""
    top = softmax(dense_recall(vectors, q_atom, k), "score", "r").select("node_id", "r")
    code = softmax(code_vectors.select("node_id", F.round(dot(F.col("embedding"), q_code), 9).alias("score")), "score", "r").select("node_id", (F.col("r") * bias).alias("r"))
    return top.unionByName(code).groupBy("node_id").agg(F.sum("r").alias("r"))


def search(atoms: DataFrame, edges: DataFrame, vectors: DataFrame, q_atom, q_code, *, level: str = "W4", top_k: int = 10, link_top_k: int = 10, status_filter=None, damping: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """(node_id, name, type, score, and context, source_pdf and status where atoms have them): the best ``top_k`` atoms of a level.

    Vectors meet vertices by id.  The status filter applies before the cut to
    ``top_k``, so as many rows come back as there are.
    """
    have = atoms.select("node_id")
    arcs = undirected(edges.join(have.withColumnRenamed("node_id", "src"), "src", "left_semi").join(have.withColumnRenamed("node_id", "tgt"), "tgt", "left_semi"))
    code = vectors.join(atoms.where(F.col("level") == "W5_code").select("node_id"), "node_id", "left_semi")
    r = restart_weights(vectors.join(have, "node_id", "left_semi"), code, q_atom, q_code, link_top_k)
    ranked = pagerank(arcs, r, damping, rounds)
    of_level = atoms.where(F.col("level") == LEVEL_ALIASES.get(level, level))
    of_level = of_level if status_filter is None else of_level.where(status_filter)
    more = [c for c in ("context", "source_pdf", "status") if c in of_level.columns]
    found = ranked.join(of_level.select("node_id", "name", "type", *more), "node_id").withColumn("score", F.round("score", 6))
    return found.orderBy(F.col("score").desc(), "node_id").limit(top_k).select("node_id", "name", "type", "score", *more)
