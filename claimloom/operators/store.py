"""The keyed store: scans, lookups and mutations as joins over snapshots."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.ontology import LEVEL_ALIASES, LEVEL_MIGRATIONS, TRUSTED_STATUSES, TYPE_MIGRATIONS, lookup
from claimloom.plans.skew import salted_join

EDGE_KEY = ["src", "tgt", "relation"]


# -- scans and lookups -------------------------------------------------------


def by_level(atoms: DataFrame, level: str, type_: str | None = None, status: str | None = "active") -> DataFrame:
    """Atoms of a level (short names allowed), optionally of a type; ``status=None`` takes all."""
    out = atoms.where(F.col("level") == LEVEL_ALIASES.get(level, level))
    out = out if type_ is None else out.where(F.col("type") == type_)
    return out if status is None else out.where(F.col("status") == status)


def by_ids(atoms: DataFrame, ids: DataFrame) -> DataFrame:
    """Atoms whose node_id is in ``ids``; a batch lookup is a semi-join."""
    return atoms.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def by_domain(atoms: DataFrame, domain: str) -> DataFrame:
    """Atoms tagged ``domain:<domain>``, of any status; tags are compared exactly."""
    return atoms.where(F.array_contains(F.from_json("tags", "array<string>"), f"domain:{domain}"))


def vectors(atoms: DataFrame, level: str | None = None) -> DataFrame:
    """(node_id, embedding) of atoms that have one."""
    out = atoms.where(F.size("embedding") > 0)
    return (out if level is None else out.where(F.col("level") == LEVEL_ALIASES.get(level, level))).select("node_id", "embedding")


def edge_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, other, relation, direction): out- and in-edges of a batch of nodes."""
    wanted = ids.select("node_id").distinct()
    out = edges.join(wanted.withColumnRenamed("node_id", "src"), "src").select(F.col("src").alias("node_id"), F.col("tgt").alias("other"), "relation", F.lit("out").alias("direction"))
    into = edges.join(wanted.withColumnRenamed("node_id", "tgt"), "tgt").select(F.col("tgt").alias("node_id"), F.col("src").alias("other"), "relation", F.lit("in").alias("direction"))
    return out.unionByName(into)


def neighbours(edges: DataFrame, ids: DataFrame, relation: str | None = None, direction: str = "both") -> DataFrame:
    """(node_id, neighbour), distinct."""
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    ends = edge_ends(e, ids)
    ends = ends if direction == "both" else ends.where(F.col("direction") == direction)
    return ends.select("node_id", F.col("other").alias("neighbour")).distinct()


def status_included(status: str | None) -> Column:
    """Filter of search results: None takes trusted statuses, 'all' everything, else equality."""
    if status is None:
        return F.coalesce(F.col("status"), F.lit("active")).isin(TRUSTED_STATUSES)
    return F.lit(True) if status == "all" else F.col("status") == status


def graph_view(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Edges both of whose endpoints exist, with type and level of both; dangling edges drop out."""
    a = atoms.select("node_id", "type", "level")
    s = a.select(F.col("node_id").alias("src"), F.col("type").alias("src_type"), F.col("level").alias("src_level"))
    t = a.select(F.col("node_id").alias("tgt"), F.col("type").alias("tgt_type"), F.col("level").alias("tgt_level"))
    return salted_join(edges.join(s, "src"), t, ["tgt"]).select("src", "tgt", "relation", "weight", "src_type", "src_level", "tgt_type", "tgt_level")


def consistency_report(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """One row: numbers of atoms, edges, dangling edges and atoms with a vector."""
    ok = edges.join(atoms.select(F.col("node_id").alias("src")), "src", "left_semi").join(atoms.select(F.col("node_id").alias("tgt")), "tgt", "left_semi")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [one(atoms, "n_atoms"), one(edges, "n_edges"), one(ok, "n_joined"), one(atoms.where(F.size("embedding") > 0), "n_vectors")]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(F.broadcast(p))  # one row each
    return row.select("n_atoms", "n_edges", (F.col("n_edges") - F.col("n_joined")).alias("n_dangling"), "n_vectors")


# -- mutations ---------------------------------------------------------------


def migrate(nodes: DataFrame) -> DataFrame:
    """Old type and level names replaced; ``n_changes`` counts both, so a row may count twice.  Idempotent."""
    new_type, new_level = lookup(F.col("type"), TYPE_MIGRATIONS, F.col("type")), lookup(F.col("level"), LEVEL_MIGRATIONS, F.col("level"))
    changed = lambda old, new: F.coalesce((F.col(old) != new).cast("int"), F.lit(0))
    return nodes.withColumns({"n_changes": changed("type", new_type) + changed("level", new_level), "new_type": new_type, "new_level": new_level}).drop("type", "level").withColumnsRenamed({"new_type": "type", "new_level": "level"})


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_ignore(held: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``new`` that an insert-or-ignore adds: first of each key, unless the key is held."""
    return first_wins(new, key, order).join(held.select(*key), key, "left_anti")


def insert_blueprint(held: DataFrame, new: DataFrame, order: list[Column], source_pdf: str | None = None) -> DataFrame:
    """The store after inserting atoms: existing ids stay as they are, of repeated new ids the first counts."""
    rows = new if source_pdf is None else new.withColumn("source_pdf", F.coalesce("source_pdf", F.lit(source_pdf)))
    return held.unionByName(insert_ignore(held, rows, ["node_id"], order))


#: How an upsert treats a column of an atom that is held already.
OVERWRITTEN = ["name", "type", "level", "context", "version", "tags", "status", "updated_at"]
FILLED = ["embedding", "code_body", "source_refs", "provenance"]


def upsert_atoms(held: DataFrame, new: DataFrame) -> DataFrame:
    """The store after an upsert: listed columns overwritten, vectors and texts kept where the new value is null, the rest kept.

    ``new`` has one row per node_id.  One full outer join on node_id.
    """
    o, n = held.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.node_id") == F.col("n.node_id"), "full_outer")
    fresh = F.col("o.node_id").isNull()
    out = [F.coalesce("o.node_id", "n.node_id").alias("node_id")]
    for c in held.columns:
        if c == "node_id":
            continue
        old, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in OVERWRITTEN:
            out.append(F.when(F.col("n.node_id").isNotNull(), now).otherwise(old).alias(c))
        elif c in FILLED:
            out.append(F.coalesce(now, old).alias(c))
        else:
            out.append(F.when(fresh, now).otherwise(old).alias(c))
    return both.select(*out)


def delete_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of ``ids``: two anti-joins."""
    gone = ids.select("node_id").distinct()
    return edges.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "tgt"), "tgt", "left_anti").select(*edges.columns)


def delete_transient(atoms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms and edges without transient atoms."""
    passing = atoms.where(F.col("status") == "transient")
    return atoms.where(~(F.coalesce(F.col("status"), F.lit("")) == "transient")), delete_touching(edges, passing)


# -- snapshots ---------------------------------------------------------------


class Conflict(RuntimeError):
    """Another writer has committed since the state was read."""


class GraphStore:
    """Atoms and edges as folders of Parquet files behind a log of commits.

    A commit names the folders that make up each table.  It is a file of its own,
    written aside and then renamed to the next number, which fails if that number is
    taken: readers see the state before or after, a crash leaves the state before,
    and of two writers that began from one state the second gets ``Conflict``.
    ``append`` adds folders, ``commit`` replaces them, and a plan may read what it
    replaces; ``vacuum`` removes folders that no recent commit names.
    """

    TABLES = ("atoms", "edges")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._file(self.path)).toUri(), conf)

    def versions(self) -> list[int]:
        """Numbers of all commits, in order."""
        log = self._file(f"{self.path}/log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n))

    def exists(self) -> bool:
        return bool(self.versions())

    def _state(self, version: int | None = None) -> dict:
        numbers = self.versions()
        if not numbers:
            raise FileNotFoundError(f"no commit in {self.path}")
        number = numbers[-1] if version is None else version
        stream = self._fs.open(self._file(f"{self.path}/log/{number}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) | {"version": number}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a commit, by default the last."""
        state = self._state(version)
        schema = T.StructType.fromJson(state["schema"][table])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in state[table]])

    @property
    def atoms(self) -> DataFrame:
        return self.read("atoms")

    @property
    def edges(self) -> DataFrame:
        return self.read("edges")

    def _log(self, state: dict, number: int) -> int:
        aside, final = self._file(f"{self.path}/log/.{uuid.uuid4().hex}"), self._file(f"{self.path}/log/{number}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        try:
            self._context.rename(aside, final, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                raise Conflict(f"commit {number} of {self.path} is taken") from e
            raise
        return number

    def commit(self, atoms: DataFrame, edges: DataFrame, *, since: int | None = None) -> int:
        """Replace both tables; returns the number of the commit.  ``since``: the commit that was read."""
        name, state = f"data-{uuid.uuid4().hex[:12]}", {"schema": {}}
        number = 1 + (max(self.versions(), default=0) if since is None else since)
        for table, df in zip(self.TABLES, (atoms, edges), strict=True):
            df.write.parquet(f"{self.path}/{name}/{table}")
            state |= {table: [f"{name}/{table}"]}
            state["schema"][table] = df.schema.jsonValue()
        return self._log(state, number)

    def append(self, atoms: DataFrame | None = None, edges: DataFrame | None = None, *, since: int | None = None) -> int:
        """Add rows to the tables, in their columns; only the new rows are written."""
        state = self._state()
        number = 1 + (state.pop("version") if since is None else since)
        name = f"data-{uuid.uuid4().hex[:12]}"
        for table, df in zip(self.TABLES, (atoms, edges), strict=True):
            if df is None:
                continue
            have = set(df.columns)
            fields = T.StructType.fromJson(state["schema"][table]).fields
            df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(f"{self.path}/{name}/{table}")
            state[table] = [*state[table], f"{name}/{table}"]
        return self._log(state, number)

    def vacuum(self, keep: int = 2) -> int:
        """Delete data that none of the last ``keep`` commits names, and older commits; returns the number of folders."""
        numbers = self.versions()
        named = {f.split("/")[0] for n in numbers[-keep:] for t in self.TABLES for f in self._state(n)[t]}
        gone = 0
        for f in self._fs.listStatus(self._file(self.path)):
            name = f.getPath().getName()
            if name.startswith("data-") and name not in named:
                gone += self._fs.delete(f.getPath(), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._file(f"{self.path}/log/{n}.json"), False)
        return gone
