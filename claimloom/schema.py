"""Schemas of the data model, and the clean views of the stored tables that operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.text import present
from claimloom.ontology import LEVEL_ALIASES, LEVEL_MIGRATIONS, LEVELS, TYPE_MIGRATIONS, lookup, relation_name

ATOMS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("node_id", "name", "type", "level", "context")]
    + [T.StructField("version", T.IntegerType()), T.StructField("source_pdf", T.StringType()), T.StructField("source_chunk", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("code_ref", "refs", "tags", "status")]
    + [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType())]
    + [T.StructField(n, T.StringType()) for n in ("code_body", "source_refs", "provenance")]
)
EDGES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("src", "tgt", "relation")] + [T.StructField("weight", T.DoubleType())] + [T.StructField(n, T.StringType()) for n in ("rho_json", "provenance")] + [T.StructField("created_at", T.TimestampNTZType())]
)

#: Every spelling of a level (short, old, untidy) by its lower-case form with underscores.
LEVEL_SPELLINGS = {k.lower(): v for k, v in ({x: x for x in LEVELS} | LEVEL_ALIASES | LEVEL_MIGRATIONS).items()}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``: missing ones are added as null, others dropped, so tables of older layouts are read alike."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def as_record(df: DataFrame) -> Column:
    """The row as a JSON object without its null fields and its vector."""
    return F.to_json(F.struct(*[c for c in df.columns if c != "embedding"]))


def type_name(c: Column) -> Column:
    """A type in the ontology's spelling, old names included; unknown ones stay as their letters."""
    bare = F.regexp_replace(F.lower(c), "[^a-z]+", "")
    return lookup(bare, TYPE_MIGRATIONS, bare)


def level_name(c: Column) -> Column:
    """A level in the ontology's spelling, old and short names included; unknown ones stay as they are."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[\s_-]+", "_")
    return lookup(bare, LEVEL_SPELLINGS, c)


def valid_json(c: Column) -> Column:
    """The string if it is JSON, else null."""
    return F.when(F.try_parse_json(c).isNotNull(), c)


def current_atoms(nodes: DataFrame, *more: str) -> DataFrame:
    """The latest row of every atom (highest version, then latest updated_at) with clean type, level and status.

    Columns: node_id, name, type, level, context, version, source_pdf, status,
    created_at and those of ``more``.  The ranking keeps one row per partition and
    atom before its shuffle; columns not asked for are not read.  ``context`` is ''
    and ``status`` 'active' where null.
    """
    cols = ["name", "type", "level", "context", "version", "source_pdf", "status", "created_at", "updated_at"]
    rows = nodes.where(F.col("node_id").isNotNull()).select("node_id", *cols, *[m for m in more if m not in cols])
    latest = Window.partitionBy("node_id").orderBy(F.col("version").desc_nulls_last(), F.col("updated_at").desc_nulls_last())
    one = rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    return one.withColumns({"type": type_name(F.col("type")), "level": level_name(F.col("level")), "context": F.coalesce("context", F.lit("")), "status": F.coalesce(F.lower("status"), F.lit("active"))}).drop(*({"updated_at"} - set(more)))


def with_provenance(atoms: DataFrame) -> DataFrame:
    """Promotes the provenance keys that rules read to columns; provenance that is no JSON counts as none."""
    p = valid_json(F.col("provenance"))
    got = {k: F.get_json_object(p, f"$.{k}") for k in ("raw_citation", "code_span", "phase")}
    nums = {k: F.get_json_object(p, f"$.{k}").try_cast("double") for k in ("score", "score_std")}
    return atoms.withColumns({"provenance": F.when(p != "{}", p), **got, **nums})


def clean_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, tgt, relation) with the relation as in the ontology; the first row wins.

    Edges with a null or blank endpoint are left out.  First is by created_at (null
    last), then by weight and texts, so the choice doesn't depend on file order.
    """
    e = edges.where(present(F.col("src")) & present(F.col("tgt"))).withColumn("relation", relation_name(F.col("relation")))
    first = Window.partitionBy("src", "tgt", "relation").orderBy(F.col("created_at").asc_nulls_last(), F.col("weight").asc_nulls_last(), F.col("rho_json").asc_nulls_last(), F.col("provenance").asc_nulls_last())
    return e.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("src", "tgt", "relation", "weight", "rho_json", "provenance", "created_at")


def edge_keys(edges: DataFrame) -> DataFrame:
    """Distinct (src, tgt, relation) of ``clean_edges``; combined before the shuffle."""
    return edges.where(present(F.col("src")) & present(F.col("tgt"))).select("src", "tgt", relation_name(F.col("relation")).alias("relation")).distinct()
