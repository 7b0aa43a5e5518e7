"""Extraction: joining segments, parsing replies into atoms and edges, resolving names, reducing levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.ontology import DEFAULT_TYPE, TYPES, lookup

#: A prompt takes so many characters.
PROMPT_CHARS = 12_000
CHUNK_MARK = "\n\n--- chunk ---\n\n"
APPROACHES = "\n\n--- approaches ---\n"

# Fields of the replies of both phases.
_PROV = "struct<code_span: string, raw_citation: string, score: double, score_std: double>"
_RHO = "struct<bottleneck: string, mechanism: string, tradeoff: string, confidence: double>"
PHASE1 = f"""struct<W1_problem: struct<name: string, type: string, context: string>,
  W2_directions: array<struct<name: string, type: string, context: string, compares_to: array<string>, provenance: {_PROV},
    W3_approaches: array<struct<name: string, type: string, context: string, compares_to: array<string>, provenance: {_PROV}>>>>>"""
PHASE2 = f"""struct<W4_implementations: array<struct<name: string, context: string, type: string, parent_W3_id: string, extends: array<string>, improves: array<string>,
  extends_rho: {_RHO}, improves_rho: {_RHO}, provenance: {_PROV}, W5_code: array<struct<name: string, context: string, type: string, code_ref: string, code_body: string, provenance: {_PROV}>>>>>"""


def prompts(segments: DataFrame, chars: int = PROMPT_CHARS, mark: str = CHUNK_MARK) -> DataFrame:
    """(source, n_segments, prompt): a source's segments in order, joined, cut to ``chars`` characters.

    A segment takes at least ``mark``, which stands between two, so only a source's first few
    hundred or thousand can begin before the cut: others are left behind before the shuffle, and
    of those few a running length tells which are gathered.  So a source with any
    number of segments is small by the time it meets in one task.
    """
    order = Window.partitionBy("source").orderBy("pos", "text")
    some = segments.select("source", "pos", F.substring("text", 1, chars).alias("text"), F.length("text").alias("n"))
    first = some.withColumn("i", F.row_number().over(order)).where(F.col("i") <= chars // len(mark) + 2)
    before = F.coalesce(F.sum(F.col("n") + len(mark)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = first.withColumn("before", before).where(F.col("before") - len(mark) < chars)
    counts = segments.groupBy("source").agg(F.count(F.lit(1)).alias("n_segments"))
    joined = near.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("s"))
    text = F.substring(F.array_join(F.transform("s", lambda x: x["text"]), mark), 1, chars)
    return joined.join(counts, "source").select("source", "n_segments", text.alias("prompt"))


def valid_type(c: Column, fallback: Column) -> Column:
    return F.when(F.lower(c).isin(TYPES), F.lower(c)).otherwise(fallback)


def atom_id(prefix: Column, name: Column, source: Column) -> Column:
    """Reproducible id: prefix, slug of the name (40), slug of the source (20), 8 hexadecimal digits of a hash."""
    s = lambda c, n: F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), 1, n)
    return F.concat_ws("_", prefix, s(name, 40), s(source, 20), F.substring(F.sha2(F.concat_ws("|", prefix, name, source), 256), 1, 8))


def parse_phase1(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies (source, reply) to atoms and edges: one problem, directions, nested approaches.

    Hierarchy edges go both ways.  ``compares`` targets are resolved by name within
    the reply; names that aren't there are left out.  A reply that is no JSON gives nothing.
    """
    r = replies.select("source", F.from_json("reply", PHASE1).alias("r")).where("r is not null")
    w1 = r.where("r.W1_problem.name is not null").select("source", F.lit("W1_problem").alias("level"), "r.W1_problem.name", "r.W1_problem.type", "r.W1_problem.context", F.lit(None).cast(_PROV).alias("prov"), F.lit(None).cast("string").alias("parent"))
    d = r.select("source", F.col("r.W1_problem.name").alias("top"), F.explode("r.W2_directions").alias("d"))
    w2 = d.select("source", F.lit("W2_direction").alias("level"), "d.name", "d.type", "d.context", F.col("d.provenance").alias("prov"), F.col("top").alias("parent"))
    a = d.select("source", F.col("d.name").alias("dir"), F.explode("d.W3_approaches").alias("a"))
    w3 = a.select("source", F.lit("W3_approach").alias("level"), "a.name", "a.type", "a.context", F.col("a.provenance").alias("prov"), F.col("dir").alias("parent"))
    rows = w1.unionByName(w2).unionByName(w3)
    prefix = F.lower(F.substring("level", 1, 2))
    typed = rows.withColumns({"type": valid_type(F.col("type"), lookup(F.col("level"), DEFAULT_TYPE)), "context": F.coalesce("context", F.lit(""))})
    atoms = typed.select(atom_id(prefix, F.col("name"), F.col("source")).alias("node_id"), "source", "name", "type", "level", "context", "parent", *_provenance())
    up = {"W2_direction": "w1", "W3_approach": "w2"}
    pairs = rows.where("parent is not null").select(atom_id(lookup(F.col("level"), up), F.col("parent"), F.col("source")).alias("p"), atom_id(prefix, F.col("name"), F.col("source")).alias("c"))
    both = F.explode(F.array(F.struct(F.col("p").alias("src"), F.col("c").alias("tgt"), F.lit("decomposes_into").alias("relation")), F.struct(F.col("c").alias("src"), F.col("p").alias("tgt"), F.lit("aggregates_to").alias("relation"))))
    edges = pairs.select(both.alias("e")).select("e.*")
    cmp_ = d.select("source", F.lit("w2").alias("p"), F.col("d.name").alias("n"), F.explode("d.compares_to").alias("other")).unionByName(a.select("source", F.lit("w3").alias("p"), F.col("a.name").alias("n"), F.explode("a.compares_to").alias("other")))
    known = atoms.select("source", F.lower("name").alias("k"), F.col("node_id").alias("tgt"))
    cmp_ = cmp_.withColumn("k", F.lower("other")).join(known, ["source", "k"]).select(atom_id(F.col("p"), F.col("n"), F.col("source")).alias("src"), "tgt", F.lit("compares").alias("relation"))
    return atoms, edges.unionByName(cmp_).distinct()


def _provenance(via: str = "phase1") -> list[Column]:
    """raw_citation, code_span, score and the provenance as JSON.

    Defaults: a citation without raw text takes its context (300), an experiment of
    the code level its code reference; without any provenance of its own an atom
    gets the phase it comes from, but not one of the code level.
    """
    citation = F.when(F.col("type") == "citation", F.coalesce("prov.raw_citation", F.substring("context", 1, 300))).otherwise(F.col("prov.raw_citation"))
    ref = F.col("code_ref") if via == "phase2" else F.lit(None)
    bare_code = (F.col("level") == "W5_code") & F.col("prov").isNull()
    span = F.when(bare_code & (F.col("type") == "experiment"), F.coalesce(F.nullif(ref, F.lit("")), F.lit("unknown"))).otherwise(F.col("prov.code_span"))
    tag = lambda value, name: F.when(F.col("prov").isNull(), F.lit(value)).alias(name)
    whole = F.to_json(F.struct(tag("extract", "phase"), tag(via, "via"), citation.alias("raw_citation"), span.alias("code_span"), F.col("prov.score").alias("score"), F.col("prov.score_std").alias("score_std")))
    return [citation.alias("raw_citation"), span.alias("code_span"), F.col("prov.score").alias("score"), F.when(~bare_code | (F.col("type") == "experiment"), whole).alias("provenance")]


def followup_prompts(prompts_: DataFrame, atoms: DataFrame) -> DataFrame:
    """(source, prompt) of the second phase: the text of the first with the approaches it gave, one a line."""
    mine = atoms.where("level = 'W3_approach'").select("source", F.col("node_id").alias("pos"), F.format_string("- %s: %s", "name", F.substring("context", 1, 200)).alias("text"))
    lines = prompts(mine, mark="\n").select("source", F.col("prompt").alias("lines"))
    return prompts_.select("source", "prompt").join(lines, "source", "left").select("source", F.concat("prompt", F.lit(APPROACHES), F.coalesce("lines", F.lit("(none)"))).alias("prompt"))


def resolve_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child_id, parent_id): a parent named by a child, by source: equal without case, else either a prefix of the other.

    Exact names meet by an equi-join.  For prefixes, each side is looked up by the
    other's whole name among the prefixes of at least one character that occur as
    lengths on the far side, which is an equi-join again instead of a nested loop.
    Of several the exact one wins, then the smallest position, then the smallest id.
    """
    c = children.select("source", "child_id", F.lower("parent_ref").alias("ref")).where(F.length("ref") > 0)
    p = parents.select("source", F.lower("name").alias("name"), "pos", "parent_id").where(F.length("name") > 0)
    exact = c.join(p, (c["source"] == p["source"]) & (c["ref"] == p["name"])).select("child_id", F.lit(0).alias("tier"), "pos", "parent_id")
    lens_c = c.groupBy("source").agg(F.collect_set(F.length("ref")).alias("ns"))  # lengths only
    lens_p = p.groupBy("source").agg(F.collect_set(F.length("name")).alias("ns"))
    p_cut = p.join(lens_c, "source").withColumn("n", F.explode("ns")).where(F.col("n") < F.length("name")).select("source", F.expr("substr(name, 1, n)").alias("key"), "pos", "parent_id")
    c_cut = c.join(lens_p, "source").withColumn("n", F.explode("ns")).where(F.col("n") < F.length("ref")).select("source", F.expr("substr(ref, 1, n)").alias("key"), "child_id")
    a = p_cut.join(c.select("source", F.col("ref").alias("key"), "child_id"), ["source", "key"]).select("child_id", F.lit(1).alias("tier"), "pos", "parent_id")
    b = c_cut.join(p.select("source", F.col("name").alias("key"), "pos", "parent_id"), ["source", "key"]).select("child_id", F.lit(1).alias("tier"), "pos", "parent_id")
    best = exact.unionByName(a).unionByName(b).groupBy("child_id").agg(F.min(F.struct("tier", "pos", "parent_id")).alias("m"))
    return best.select("child_id", F.col("m.parent_id").alias("parent_id"))


def parse_phase2(replies: DataFrame, approaches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies (source, reply) of the second phase to atoms and edges; parents are looked up among ``approaches`` (source, name, pos, parent_id).

    extends / improves name their targets; they are resolved by name among the
    reply's own atoms and stay as names where that fails.  Evidence without content is null.
    """
    r = replies.select("source", F.from_json("reply", PHASE2).alias("r")).where("r is not null")
    w = r.select("source", F.explode("r.W4_implementations").alias("w"))
    w4 = w.select("source", F.lit("W4_implementation").alias("level"), "w.name", "w.type", "w.context", F.col("w.parent_W3_id").alias("parent"), F.lit(None).cast("string").alias("code_ref"), F.lit(None).cast("string").alias("code_body"), F.col("w.provenance").alias("prov"))
    c = w.select("source", F.col("w.name").alias("up"), F.explode("w.W5_code").alias("c"))
    w5 = c.select("source", F.lit("W5_code").alias("level"), "c.name", "c.type", "c.context", F.col("up").alias("parent"), "c.code_ref", "c.code_body", F.col("c.provenance").alias("prov"))
    rows = w4.unionByName(w5)
    prefix = F.lower(F.substring("level", 1, 2))
    nid = atom_id(prefix, F.col("name"), F.col("source"))
    typed = rows.withColumns({"type": valid_type(F.col("type"), lookup(F.col("level"), DEFAULT_TYPE)), "context": F.coalesce("context", F.lit(""))})
    atoms = typed.select(nid.alias("node_id"), "source", "name", "type", "level", "context", "parent", "code_ref", "code_body", *_provenance("phase2"))
    refs = atoms.where("level = 'W4_implementation'").select("source", F.col("node_id").alias("child_id"), F.col("parent").alias("parent_ref"))
    up = resolve_parents(refs, approaches)
    hier = F.explode(F.array(F.struct(F.col("parent_id").alias("src"), F.col("child_id").alias("tgt"), F.lit("decomposes_into").alias("relation")), F.struct(F.col("child_id").alias("src"), F.col("parent_id").alias("tgt"), F.lit("aggregates_to").alias("relation"))))
    none = F.lit(None).cast("string").alias("rho_json")
    e1 = up.select(hier.alias("e")).select("e.*", none)
    e2 = atoms.where("level = 'W5_code' and parent is not null").select(atom_id(F.lit("w4"), F.col("parent"), F.col("source")).alias("src"), F.col("node_id").alias("tgt"), F.lit("decomposes_into").alias("relation"), none)
    parts = []
    known = atoms.select("source", F.lower("name").alias("k"), F.col("node_id").alias("t")).groupBy("source", "k").agg(F.min("t").alias("t"))
    for rel in ("extends", "improves"):
        rho = F.to_json(F.when(F.coalesce(*[F.col(f"w.{rel}_rho.{f}").cast("string") for f in ("bottleneck", "mechanism", "tradeoff", "confidence")]).isNotNull(), F.col(f"w.{rel}_rho")))
        x = w.select("source", F.col("w.name").alias("n"), rho.alias("rho_json"), F.explode(f"w.{rel}").alias("other")).withColumn("k", F.lower("other")).join(known, ["source", "k"], "left")
        parts.append(x.select(atom_id(F.lit("w4"), F.col("n"), F.col("source")).alias("src"), F.coalesce("t", "other").alias("tgt"), F.lit(rel).alias("relation"), "rho_json"))
    return atoms, e1.unionByName(e2).unionByName(parts[0]).unionByName(parts[1]).distinct()


# Fixed value: how an arXiv id stands in a citation.
ARXIV = r"(?i)(?:arxiv[:\s])?(\d{4}\.\d{4,5}(?:v\d+)?)"


def arxiv_id(c: Column) -> Column:
    """First arXiv id in a text, with its version if it has one; '' if there is none."""
    return F.regexp_extract(c, ARXIV, 1)


def atom_feed(xml: Column) -> list[Column]:
    """First entry of an Atom feed: title, summary, year, authors, arxiv_id; null where there is none."""
    entry = F.regexp_extract(xml, r"(?s)<entry>(.*?)</entry>", 1)
    first = lambda pattern, g=1: F.nullif(F.regexp_extract(entry, pattern, g), F.lit(""))
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return [
        plain(F.regexp_extract(entry, r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        plain(F.regexp_extract(entry, r"(?s)<summary[^>]*>(.*?)</summary>", 1)).alias("summary"),
        first(r"<published>(\d{4})").cast("int").alias("year"),
        F.regexp_extract_all(entry, F.lit("<name>(.*?)</name>"), 1).alias("authors"),
        first(r"<id>(?:http://arxiv\.org/abs/)?([^<]+)</id>").alias("arxiv_id"),
    ]


def fenced_json(c: Column) -> Column:
    """The reply itself if it begins as JSON, else the content of its first fenced block, if there is one."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when((inner != "") & ~c.rlike(r"^\s*[\[{]"), F.trim(inner)).otherwise(c)
