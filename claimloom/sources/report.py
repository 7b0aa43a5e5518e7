"""Graph and audit pages: tables as JSON inside HTML files, as many files as the graph needs."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.reports import audit_cards, cards
from claimloom.plans.ship import ship
from claimloom.sources.files import absolute, write_text

#: About so many atoms and edges stand on one page; larger graphs take more pages.
PAGE_ATOMS, PAGE_EDGES = 2_000, 6_000

# Colours by status; other statuses are grey.
COLOURS = {"verified": "#2e7d32", "active": "#1565c0", "skipped": "#757575", "needs_review": "#ef6c00", "low_confidence": "#f9a825", "low_reliability": "#c62828", "demoted": "#6a1b9a", "merged": "#9e9e9e", "transient": "#bdbdbd"}
GREY = "#9e9e9e"
# Colours of the bands of verified shares.
BANDS = {"good": "#2e7d32", "fair": "#f9a825", "poor": "#c62828"}


def escape(c):
    """HTML form of a string column."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_tables(atoms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, label, group, colour), links and cards of a page."""
    colour = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), F.col("status")), F.lit(GREY))
    nodes = atoms.select(F.col("node_id").alias("id"), escape(F.coalesce("name", F.lit(""))).alias("label"), F.col("level").alias("group"), "status", colour.alias("colour"))
    return nodes, edges.select("src", "tgt", "relation"), cards(atoms, "level")


def with_checks(atoms: DataFrame, verdicts: DataFrame, order: str = "pos") -> DataFrame:
    """Atoms with ``checks`` of their verdicts (node_id, checks, ``order``); of several reports the last wins, none gives an empty map."""
    last = verdicts.groupBy("node_id").agg(F.max_by("checks", order).alias("checks"))
    return atoms.join(last, "node_id", "left").withColumn("checks", F.coalesce("checks", F.expr("cast(map() as map<string,string>)")))


def _page(title: str, data: dict) -> str:
    inside = json.dumps(data, ensure_ascii=False).replace("</", "<\\/")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><script type='application/json' id='graph'>{inside}</script>"


def write_pages(atoms: DataFrame, edges: DataFrame, folder: str, title: str = "Claim graph", verdicts: DataFrame | None = None) -> str:
    """The whole graph as pages in a shared folder; returns the path of the index.

    Atoms and edges are spread over as many pages as they need by a hash, each page
    written where its rows are.  ``verdicts`` (label, node_id, type, status, checks,
    pos) of audits give each atom its checks and the index a card per label.  The
    index has the cards, a legend and links to the pages.
    """
    ship(atoms.sparkSession)
    if verdicts is not None:
        atoms = with_checks(atoms, verdicts)
    nodes, links, card = page_tables(atoms, edges)
    extra = [c for c in ("type", "source_pdf", "context", "provenance", "checks") if c in atoms.columns]
    nodes = nodes.join(atoms.select(F.col("node_id").alias("id"), *[F.to_json(c).alias(c) if c == "checks" else F.col(c) for c in extra]), "id")
    n_pages = max(1, -(-atoms.count() // PAGE_ATOMS), -(-edges.count() // PAGE_EDGES))
    row = lambda kind, df, key: df.select(F.pmod(F.xxhash64(*key), F.lit(n_pages)).cast("int").alias("page"), F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("row"))
    rows = row("nodes", nodes, ["id"]).unionByName(row("links", links, ["src", "tgt", "relation"]))
    folder = absolute(folder)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["page"].iloc[0])
        data = {k: sorted((json.loads(r) for r in pdf.loc[pdf["kind"] == k, "row"]), key=lambda r: json.dumps(r, sort_keys=True)) for k in ("nodes", "links")}
        name = f"page-{number:06}.html"
        write_text(folder, name, _page(f"{title}, page {number + 1} of {n_pages}", data))
        return pd.DataFrame({"name": [name], "n_nodes": [len(data["nodes"])], "n_links": [len(data["links"])]})

    pages = rows.groupBy("page").applyInPandas(write, "name string, n_nodes bigint, n_links bigint")
    done = {r["name"]: r for r in pages.collect()}  # one short row a page
    items = [f"<li>{html.escape(str(r['level']))} · {html.escape(str(r['status']))}: {r['n']} ({r['percent']} %)</li>" for r in card.orderBy("level", "status").collect()]
    legend = [f"<li style='color:{c}'>{html.escape(s)}</li>" for s, c in COLOURS.items()]
    audits = [] if verdicts is None else [_audit_card(r.asDict()) for r in audit_cards(verdicts, "label").orderBy("label").toLocalIterator()]
    listed = "".join(f"<li><a href='{n}'>{n}</a> {r['n_nodes']} atoms, {r['n_links']} links</li>" for n, r in sorted(done.items()))
    text = f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(audits)}<ul>{''.join(items)}</ul><ul>{''.join(legend)}</ul><ul>{listed}</ul>"
    write_text(folder, "index.html", text)
    return f"{folder}/index.html"


def _audit_card(r: dict) -> str:
    fails = " ".join(f"{c}: {r[f'failed_{c.lower()}']}" for c in ("I1", "I2", "I3", "I4"))
    return f"<div><b>{html.escape(str(r['label']))}</b> <span style='color:{BANDS[r['band']]}'>{100 * r['cpr']:.0f} %</span> audited {r['n_audited']}, passed {r['n_passed']}, failed {r['n_failed']}, skipped {r['n_skipped']}; {fails}</div>"


def graphml(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the lines of a GraphML file; parts in order are head, nodes, edges, tail."""
    spark = atoms.sparkSession
    node = F.format_string('<node id="%s"><data key="label">%s</data><data key="type">%s</data><data key="level">%s</data></node>', escape(F.col("node_id")), escape(F.coalesce("name", F.lit(""))), "type", "level")
    edge = F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data></edge>', escape(F.col("src")), escape(F.col("tgt")), "relation")
    head = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    return head.unionByName(atoms.select(F.lit(1).alias("part"), node.alias("line"))).unionByName(edges.select(F.lit(2).alias("part"), edge.alias("line")))
