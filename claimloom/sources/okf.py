"""Markdown bundles: one file per atom with front matter, relations as links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.json import merged
from claimloom.ontology import HIERARCHY, HORIZONTAL, LEVELS, TYPES
from claimloom.operators import store
from claimloom.plans.lineage import cut
from claimloom.plans.ship import ship
from claimloom.plans.skew import salted_join
from claimloom.schema import ATOMS, EDGES, conform
from claimloom.sources.files import absolute, open_text, write_text

RESERVED = ["index.md", "log.md"]
#: Prefix of the front matter keys that go beyond the open format.  Any writer's prefix is read.
PREFIX = "claimloom"
#: A link at the end of a line; its title may hold brackets.
LINK = r"\]\(([^()]+)\)\s*$"
EXTENSIONS = ("node_id", "level", "status", "provenance", "source_refs", "code_ref", "part_of")
#: About so many links of an atom stand in one file; a hub's further ones stand in more files.
PART_LINES = 100_000


def slug(c: Column) -> Column:
    """File-safe form: runs of other characters to one underscore, no outer dots and underscores, 80 at most."""
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(s, "^[._]+|[._]+$", "")
    return F.substring(F.when(s == "", "concept").otherwise(s), 1, 80)


def concept_path(level: str = "level", node_id: str = "node_id") -> Column:
    return F.concat(F.col(level), F.lit("/"), slug(F.col(node_id)), F.lit(".md"))


def relation_lines(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """(node_id, part, lines): links to exported atoms, outgoing first, each by relation and id.

    An atom with at most about ``PART_LINES`` links has one part, 0.  The links of
    a hub are spread over more parts by a hash, so that no row holds more.
    """
    ends = atoms.select("node_id", F.regexp_replace("name", r"[\r\n]+", " ").alias("name"), concept_path().alias("path"))  # a link stands on one line
    one = lambda mine, far, d, arrow: salted_join(edges, ends.withColumnRenamed("node_id", far), [far]).select(F.col(mine).alias("node_id"), F.lit(d).alias("d"), "relation", F.col(far).alias("o"), F.format_string(f"- %s {arrow} [%s](%s)", "relation", "name", "path").alias("line"))
    links = one("src", "tgt", 0, "→").unionByName(one("tgt", "src", 1, "←"))
    sizes = links.groupBy("node_id").agg(F.ceil(F.count(F.lit(1)) / PART_LINES).cast("int").alias("n_parts"))
    several = salted_join(links, sizes.where("n_parts > 1"), ["node_id"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("d", "relation", "o"), F.col("n_parts")), F.lit(0)).cast("int")
    rows = several.groupBy("node_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("d", "relation", "o", "line"))).alias("x"))  # a part
    return rows.select("node_id", "part", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("lines"))


def concepts(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, content): the files of a bundle, without index and log.

    A hub's further links stand in files of their own beside it, which name it as
    what they are part of.
    """
    quoted = lambda c: F.expr(f"regexp_replace(regexp_replace(to_json(named_struct('x', coalesce({c}, ''))), '^.{{5}}', ''), '.$', '')")
    head = [("type", quoted("type")), ("title", quoted("name")), ("description", quoted("substring(context, 1, 500)")), ("resource", quoted("source_pdf")), ("tags", F.coalesce("tags", F.lit("[]"))), ("timestamp", quoted("date_format(updated_at, 'yyyy-MM-dd HH:mm:ss')")), (f"{PREFIX}_node_id", quoted("node_id")), (f"{PREFIX}_level", quoted("level")), (f"{PREFIX}_status", quoted("status")), (f"{PREFIX}_provenance", F.coalesce("provenance", F.lit("{}")))]
    front = F.concat(F.lit("---\n"), *[x for k, v in head for x in (F.lit(f"{k}: "), v, F.lit("\n"))], F.lit("---\n\n"))
    code = F.when(F.length("code_body") > 0, F.concat(F.lit("\n## Code\n```python\n"), "code_body", F.lit("\n```\n"))).otherwise("")
    links = F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n## Relations\n"), "lines", F.lit("\n"))).otherwise("")
    prov = F.when(F.col("provenance").isNotNull(), F.concat(F.lit("\n## Provenance\n```json\n"), "provenance", F.lit("\n```\n"))).otherwise("")
    full = atoms.join(relation_lines(edges, atoms), "node_id", "left")
    whole = F.concat(front, F.coalesce("context", F.lit("")), F.lit("\n"), code, links, prov)
    more = F.concat(F.lit(f"---\n{PREFIX}_part_of: "), quoted("node_id"), F.lit("\n---\n"), links)
    beside = F.regexp_replace(concept_path(), r"\.md$", "")
    first = F.coalesce("part", F.lit(0)) == 0
    return full.select(F.when(first, concept_path()).otherwise(F.concat(beside, F.format_string(".links-%05d.md", "part"))).alias("path"), F.when(first, whole).otherwise(more).alias("content"))


def index_lines(atoms: DataFrame) -> DataFrame:
    """(level, pos, line): the index, level by level, atoms by name and id."""
    line = F.format_string("- [%s](%s)  · `%s` · %s", F.coalesce("name", F.lit("")), concept_path(), "type", "status")
    order = F.struct(F.coalesce("name", F.lit("")), "node_id")
    return atoms.select("level", order.alias("o"), line.alias("line")).select("level", "o", "line")


def log_lines(atoms: DataFrame) -> DataFrame:
    """(at, node_id, line): the log by time of update, unknown times first."""
    at = F.coalesce(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return atoms.select(at.alias("at"), "node_id", F.format_string("- %s · `%s` · %s · %s", F.when(at == "", "?").otherwise(at), "node_id", F.coalesce("name", F.lit("")), "status").alias("line"))


def export(atoms: DataFrame, edges: DataFrame, folder: str, source: str | None = None) -> str:
    """Write a bundle, on request only of one source, to a folder that all workers share; returns its URI.

    Concept files are written where their rows are; index and log are written in
    order, part by part, from a sorted iterator.
    """
    folder = absolute(folder)
    if source is not None:
        atoms = atoms.where(F.col("source_pdf") == source)
    ship(atoms.sparkSession)

    def write(rows) -> None:
        for r in rows:
            write_text(folder, r["path"], r["content"])

    concepts(atoms, edges).foreachPartition(write)
    with open_text(folder, "index.md") as f:
        f.write(b"# Index\n")
        for level in LEVELS:
            mine = index_lines(atoms).where(F.col("level") == level)
            f.write(f"\n## {level}  ({mine.count()})\n".encode())
            for r in mine.orderBy("o").toLocalIterator():
                f.write((r["line"] + "\n").encode())
    with open_text(folder, "log.md") as f:
        f.write(b"# Log\n\n")
        for r in log_lines(atoms).orderBy("at", "node_id").toLocalIterator():
            f.write((r["line"] + "\n").encode())
    return folder


# -- reading -----------------------------------------------------------------


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): every markdown file but the reserved ones, paths relative to the bundle."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    base = re.sub("^file:/*", "/", absolute(folder)).rstrip("/") + "/"
    path = F.regexp_replace(F.expr("url_decode(_metadata.file_path)"), "^file:/*", "/")
    rel = F.expr(f"replace(p, {json.dumps(base)}, '')")
    rows = files.select(path.alias("p"), F.col("value").alias("text")).select(rel.alias("path"), "text")
    return rows.where(~F.lower(F.element_at(F.split("path", "/"), -1)).isin(RESERVED))


def split_front(bundle: DataFrame) -> DataFrame:
    """(path, meta, body): front matter as JSON and the rest; text without front matter has meta '{}', broken YAML null."""
    ship(bundle.sparkSession)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [_front(t or "") for t in b["text"]]
            yield pd.DataFrame({"path": b["path"], "meta": [m for m, _ in done], "body": [x for _, x in done]})

    return bundle.select("path", "text").mapInPandas(split, "path string, meta string, body string")


def _front(text: str) -> tuple[str | None, str]:
    m = re.match(r"---(.*?)\n---[^\n]*\n?(.*)\Z", text, re.S)
    if not m:
        return "{}", text
    meta = _yaml(m[1])
    if meta is None:
        return None, ""
    own = {f"{PREFIX}_{x}": v for k, v in meta.items() for x in EXTENSIONS if re.fullmatch(rf"[a-z0-9]+_{x}", str(k))}
    return json.dumps(meta | own, ensure_ascii=False, default=str), m[2].lstrip("\n")


def _yaml(block: str) -> dict | None:
    """A YAML mapping; without a YAML library, flat keys whose values are JSON or plain text."""
    try:
        import yaml
    except ImportError:
        out = {}
        for line in block.splitlines():
            key, colon, value = line.partition(":")
            if line.strip() and colon and not line[0].isspace():
                try:
                    out[key.strip()] = json.loads(value.strip())
                except ValueError:
                    out[key.strip()] = value.strip()
            elif line.strip() and not line.lstrip().startswith(("-", "#")):
                return None
        return out
    try:
        meta = yaml.safe_load(block) or {}
        return meta if isinstance(meta, dict) else None
    except yaml.YAMLError:
        return None


def to_atoms(split: DataFrame) -> DataFrame:
    """Atoms of a read bundle: unknown types become concept (the original is recorded), unknown levels W3_approach.

    Files with broken front matter are left out.  Ids: the bundle's own key, then
    node_id, then the path.  A missing description is the first line of the body, up to 500.
    """
    m = lambda k: F.get_json_object("meta", f"$.{k}")
    first_line = F.substring(F.split(F.trim("body"), "\n")[0], 1, 500)
    t, lv = F.coalesce(m("type"), F.lit("")), F.coalesce(m(f"{PREFIX}_level"), m("level"), F.lit(""))
    ok = split.where(F.col("meta").isNotNull() & m(f"{PREFIX}_part_of").isNull())
    return ok.select(
        F.coalesce(F.nullif(m(f"{PREFIX}_node_id"), F.lit("")), F.nullif(m("node_id"), F.lit("")), F.regexp_replace("path", r"\.md$", "")).alias("node_id"),
        "path",
        F.coalesce(F.nullif(m("title"), F.lit("")), F.nullif(m(f"{PREFIX}_node_id"), F.lit("")), F.regexp_replace("path", r"\.md$", "")).alias("name"),
        F.when(t.isin(TYPES), t).otherwise("concept").alias("type"),
        F.when(lv.isin(LEVELS), lv).otherwise("W3_approach").alias("level"),
        F.coalesce(F.nullif(m("description"), F.lit("")), first_line).alias("context"),
        F.nullif(m("resource"), F.lit("")).alias("source_pdf"),
        F.coalesce(F.nullif(m(f"{PREFIX}_status"), F.lit("")), F.lit("active")).alias("status"),
        F.when(~t.isin(TYPES) & (t != ""), t).alias("original_type"),
        F.when(F.get_json_object("meta", "$.tags").startswith("["), m("tags")).alias("tags"),
        m(f"{PREFIX}_provenance").alias("provenance"),
        m(f"{PREFIX}_source_refs").alias("source_refs"),
        m(f"{PREFIX}_code_ref").alias("code_ref"),
        F.regexp_extract("body", r"(?s)(?:^|\n)## Code\n```python\n(.*?)\n```\n", 1).alias("code_body"),
    ).withColumns({"code_body": F.nullif("code_body", F.lit("")), "provenance": F.when(F.col("original_type").isNotNull(), merged(F.col("provenance"), F.to_json(F.struct(F.col("original_type"))))).otherwise(F.col("provenance"))})


def relations(bodies: DataFrame) -> DataFrame:
    """(path, pos, relation, incoming, target): links in the Relations section of each body (path, body)."""
    lines = bodies.select("path", F.posexplode(F.split("body", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    upto = Window.partitionBy("path").orderBy("pos")
    section = F.last(F.when(F.col("line").startswith("## "), F.lower("line")), ignorenulls=True).over(upto)
    rows = lines.withColumn("section", section).where(F.col("section").startswith("## relation") & F.col("line").rlike(LINK))
    prefix = F.regexp_replace(F.regexp_replace(F.split("line", r"\[")[0], "^[- ]+", ""), "[→←]", "")
    rel = F.trim(prefix)
    return rows.select("path", "pos", F.when(rel.isin(HORIZONTAL + HIERARCHY), rel).otherwise("related_to").alias("relation"), F.split("line", r"\[")[0].contains("←").alias("incoming"), F.regexp_extract("line", LINK, 1).alias("target"))


def resolve_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds ``node_id`` of the linked file: same path (slashes normalised), else the first of the same base name."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("target", r"[#?].*$", ""), r"^[./\\]+", ""), r"\\", "/")
    l_ = links.withColumn("key", bare).withColumn("base", F.element_at(F.split("key", "/"), -1))
    exact = paths.select(F.col("path").alias("key"), F.col("node_id").alias("n1")).dropDuplicates(["key"])
    base = paths.groupBy(F.element_at(F.split("path", "/"), -1).alias("base")).agg(F.min_by("node_id", "path").alias("n2"))
    return l_.join(exact, "key", "left").join(base, "base", "left").withColumn("node_id", F.coalesce("n1", "n2")).drop("key", "base", "n1", "n2")


def import_bundle(spark: SparkSession, folder: str, *, direction_aware: bool = True) -> tuple[DataFrame, DataFrame]:
    """Atoms and edges of a bundle.  Incoming links give the edge they show; ``direction_aware=False`` reads every link as outgoing."""
    split = split_front(read_bundle(spark, folder))
    atoms = to_atoms(split)
    ids = atoms.select("path", "node_id")
    links = resolve_links(relations(split.where("meta is not null").select("path", "body")), ids).where("node_id is not null")
    part_of = F.get_json_object("meta", f"$.{PREFIX}_part_of")
    parts = split.where(part_of.isNotNull()).select("path", part_of.alias("own"))
    mine = ids.withColumnRenamed("node_id", "own").unionByName(parts)
    e = links.join(mine, "path")
    flip = F.col("incoming") & F.lit(direction_aware)
    edges = e.select(F.when(flip, F.col("node_id")).otherwise(F.col("own")).alias("src"), F.when(flip, F.col("own")).otherwise(F.col("node_id")).alias("tgt"), "relation").where("src <> tgt").distinct()
    return atoms, edges


def import_into(base: store.GraphStore, folder: str, **named) -> dict:
    """Insert a bundle into a base: atoms and edges held already stay.  Returns atoms_imported, edges_imported and concepts_skipped."""
    spark = base.spark
    skipped = split_front(read_bundle(spark, folder)).where("meta is null").count()
    atoms, edges = import_bundle(spark, folder, **named)
    atoms = cut(atoms.withColumns({"source_pdf": F.coalesce("source_pdf", F.lit("bundle import")), "version": F.lit(1)}))
    known = atoms.select("node_id")
    edges = cut(edges.join(known.withColumnRenamed("node_id", "src"), "src", "left_semi").join(known.withColumnRenamed("node_id", "tgt"), "tgt", "left_semi"))
    out = {"atoms_imported": atoms.count(), "edges_imported": edges.count(), "concepts_skipped": skipped}
    a, e = conform(atoms, ATOMS), conform(edges, EDGES).withColumn("weight", F.lit(1.0))
    if not base.exists():
        base.commit(store.first_wins(a, ["node_id"], [F.col("name")]), store.first_wins(e, store.EDGE_KEY, [F.col("weight")]))
    else:
        base.append(store.insert_ignore(base.atoms, a, ["node_id"], [F.col("name")]), store.insert_ignore(base.edges, e, store.EDGE_KEY, [F.col("weight")]))
    return out
