"""Incremental ingest with Structured Streaming: segments in, appended commits out, idempotent by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators.store import GraphStore, first_wins

KEY = ["source", "pos"]


def segment_atoms(segments: DataFrame) -> DataFrame:
    """One transient-free atom per segment: a reproducible id, the text as context."""
    nid = F.concat(F.lit("seg_"), F.substring(F.sha2(F.concat_ws("|", F.col("source"), F.col("pos").cast("string")), 256), 1, 12))
    return segments.select(nid.alias("node_id"), "source", "pos", F.substring("text", 1, 80).alias("name"), F.lit("concept").alias("type"), F.lit("W3_approach").alias("level"), F.col("text").alias("context"), F.lit("active").alias("status"))


def ingest_batch(store: GraphStore, batch: DataFrame) -> None:
    """Adds a batch to the store; what is there already stays, so a repeated batch changes nothing."""
    new = first_wins(segment_atoms(batch), ["node_id"], [F.col("context")])
    no_edges = batch.sparkSession.createDataFrame([], "src string, tgt string, relation string")
    if not store.exists():
        store.commit(new, no_edges)
        return
    store.append(new.join(store.atoms.select("node_id"), "node_id", "left_anti"))


def ingest_stream(segments: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """Starts a query that ingests a stream of segments (source, pos, text) batch by batch."""
    return segments.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: ingest_batch(store, df)).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and key, with a watermark; an addition beyond batch semantics."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a time zone
    return timed.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
