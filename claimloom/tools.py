"""Tool handlers: names and arguments to plain results, for any server to wrap.

Every handler gives {"result": ...} or {"error": text}, as a tool protocol wants it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import ontology as O
from claimloom import providers
from claimloom.api import Engine
from claimloom.operators import validate
from claimloom.operators.extract import fenced_json

#: Results that a tool returns are shown whole; searches are as long as they are asked for.
ATOMS_V2 = "struct<atoms: array<struct<name: string, type: string, context: string>>, edges: array<struct<src: string, relation: string, tgt: string, rho: string>>>"


def _segments(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "pos int, text string")


def call(engine: Engine, name: str, arguments: dict) -> dict:
    """A tool of the current layer: build_index, search, evaluate_novelty or get_schema."""
    spark = engine.spark
    handlers: dict[str, Callable[[], object]] = {
        "build_index": lambda: engine.ingest(_segments(spark, arguments["segments"]), arguments["source_pdf"], task_spec=arguments.get("task_spec")),
        "search": lambda: [r.asDict() for r in engine.search(arguments["query"], arguments.get("top_k", 10), arguments.get("level", "W4"), arguments.get("status")).collect()],  # top_k rows
        "evaluate_novelty": lambda: engine.evaluate(_segments(spark, [arguments["proposal_text"]]), arguments.get("domain")),
        "get_schema": engine.schema,
    }
    return _answer(handlers, name)


def call_v2(spark: SparkSession, name: str, arguments: dict, model: providers.Model | None = None) -> dict:
    """A tool of the older layer: extract_blueprint, extract_batch, validate_blueprint or get_schema."""

    def batch(texts: list[str]) -> list[dict]:
        out = [{"atoms": [], "edges": []} for _ in texts]
        atoms, edges = extract_v2(_segments(spark, texts), model)
        for r in atoms.toLocalIterator():
            out[r["pos"]]["atoms"].append({k: v for k, v in r.asDict().items() if k != "pos" and v is not None})
        for r in edges.toLocalIterator():
            out[r["pos"]]["edges"].append({k: r[k] for k in ("src", "relation", "tgt")} | ({"rho": json.loads(r["rho"])} if r["rho"] else {}))
        return out

    def check() -> dict:
        a, e = arguments.get("atoms", []), arguments.get("edges", [])
        atoms = spark.createDataFrame([(i, str(x.get("name", "?")), x.get("type")) for i, x in enumerate(a)], "pos int, name string, type string")
        edges = spark.createDataFrame([(x.get("src"), x.get("relation"), x.get("tgt"), bool(x.get("rho"))) for x in e], "src string, relation string, tgt string, has_rho boolean")
        atoms, edges = validate.v2_coerce(atoms, edges)
        errors = [r["message"] for r in validate.v2_validate(atoms, edges).collect()]  # a call's own errors
        return {"valid": not errors, "error_count": len(errors), "errors": errors, "atom_count": len(a), "edge_count": edges.count()}

    handlers: dict[str, Callable[[], object]] = {
        "extract_blueprint": lambda: batch([arguments["text"]])[0],
        "extract_batch": lambda: batch(arguments["segments"]),
        "validate_blueprint": check,
        "get_schema": lambda: {"atom_types": validate.V2_TYPES, "edge_types": validate.V2_RELATIONS, "strong_causal": sorted(validate.V2_STRONG), "categories": O.CATEGORIES, "matrix": {r: [f"{a}→{b}" for a, b in pairs] for r, pairs in validate.V2_MATRIX.items()}},
    }
    return _answer(handlers, name)


def _answer(handlers: dict[str, Callable[[], object]], name: str) -> dict:
    if name not in handlers:
        raise ValueError(f"unknown tool {name}")
    try:
        return {"result": handlers[name]()}
    except Exception as e:  # noqa: BLE001 - a tool reports its failure
        return {"error": str(e)}


def extract_v2(segments: DataFrame, model: providers.Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Atoms (pos, name, type, context) and edges (pos, src, relation, tgt, rho) of segments (pos, text), one model call each.

    What a segment's reply holds is filtered on its own (``validate.v2_filter``); a
    call that fails or a reply that is no JSON gives nothing.  ``pos`` keeps the order.
    """
    replies = providers.ask(segments.select("pos", F.col("text").alias("prompt")), "pos", model, task="blueprint")
    r = replies.select("pos", F.from_json(fenced_json(F.col("reply")), ATOMS_V2).alias("r")).where("r is not null")
    atoms = r.select("pos", F.posexplode("r.atoms").alias("i", "a")).select("pos", "i", "a.name", F.lower("a.type").alias("type"), "a.context")
    atoms = atoms.where(validate.valid_name(F.col("name")) & F.col("type").isin(validate.V2_TYPES))
    e = r.select("pos", F.explode("r.edges").alias("e")).select("pos", "e.src", F.upper("e.relation").alias("relation"), "e.tgt", F.nullif(F.nullif("e.rho", F.lit("{}")), F.lit("null")).alias("rho"))
    e = e.where(F.col("relation").isin(validate.V2_RELATIONS) & (~F.col("relation").isin(validate.V2_STRONG) | F.col("rho").isNotNull()))
    names = atoms.select("pos", "name").distinct()
    e = e.join(names.withColumnRenamed("name", "src"), ["pos", "src"], "left_semi").join(names.withColumnRenamed("name", "tgt"), ["pos", "tgt"], "left_semi")
    return atoms.drop("i"), e.select("pos", "src", "relation", "tgt", "rho")
