import json

import duckdb

from claimloom.queries import pipeline
from claimloom.schema import ATOMS


def test_a_reply_without_authors_and_a_very_long_citation(spark, rows, tmp_path):
    """OpenAlex replies name no authors here; the longest citations are answered too, as in SQL."""
    said = ["c" * 30, "x" * 50 + " 1706.03762 tail", "o" * 80, "r" * 95, "z" * 120_000, "", None]
    made = [(f"n{i}", f"N{i}", 1, json.dumps({"raw_citation": c} if c is not None else {"phase": "p"})) for i, c in enumerate(said)]
    nodes = spark.createDataFrame([tuple({"node_id": n, "name": name, "version": v, "provenance": p}.get(f, None) for f in ATOMS.names) for n, name, v, p in made], ATOMS)
    nodes.write.parquet(str(tmp_path / "cc_nodes.parquet"))
    got = pipeline.service_replies(spark, str(tmp_path))
    assert {r["node_id"]: (r["source_api"], r["n_authors"], r["author"]) for r in got.collect()} == {
        "n0": ("semantic_scholar", 5, "ccccccc"), "n1": ("arxiv", 1, "C"), "n2": ("openalex", 0, None), "n3": ("crossref", 1, "A B"), "n4": ("crossref", 1, "A B"), "n5": (None, None, None),
    }
    con = duckdb.connect()
    con.execute(f"CREATE VIEW cc_nodes AS SELECT * FROM read_parquet('{tmp_path}/cc_nodes.parquet/*.parquet')")
    want = con.execute(pipeline.SQL["service_replies"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
