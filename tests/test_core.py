import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom import ontology as O
from claimloom import providers
from claimloom.functions import text
from claimloom.functions.vectors import cosine, word_hash
from claimloom.operators import audit, consolidate, extract, graph, novelty, store, validate, vote
from claimloom.sources import okf, report


def test_text_predicates(spark):
    df = spark.createDataFrame([("a",), ("  \n",), ("",), (None,), (" N/A ",), ("none.",)], "x string")
    got = df.select(text.present(F.col("x")).alias("p"), text.has_value(F.col("x")).alias("v"), text.letters_digits(F.col("x")).alias("l")).collect()
    assert [r["p"] for r in got] == [True, False, False, False, True, True]
    assert [bool(r["v"]) for r in got] == [True, False, False, False, False, True]
    same = spark.createDataFrame([("Straße-1",), ("STRASSE 1",), ("Σίσυφος",), ("ΣΊΣΥΦΟΣ",)], "x string").select(text.letters_digits(F.col("x")).alias("l")).collect()
    assert same[0]["l"] == same[1]["l"] and same[2]["l"] == same[3]["l"]


A = "node_id string, name string, type string, level string, context string, status string, created_at timestamp_ntz, provenance string, score double, raw_citation string"


def atoms(spark, *rows_):
    return spark.createDataFrame([(i, n, t, lv, "", "active", None, p, s, c) for i, n, t, lv, p, s, c in rows_], A)


def test_rules(spark, rows):
    a = atoms(spark, ("m1", "X", "method", "W3_approach", "{}x", None, None), ("m2", "x", "method", "W3_approach", None, None, None), ("b", "B", "bottleneck", "W1_problem", None, None, None), ("n", "N", "numerical", "W5_code", "p", None, None), ("z", "Z", "nothing", "W9", None, None, None))
    e = spark.createDataFrame([("m1", "m2", "extends", None), ("m1", "b", "extends", "{}"), ("m1", "b", "aggregates_to", None), ("b", "m1", "aggregates_to", None), ("m1", "no", "background", None), ("m1", "b", "strange", None)], "src string, tgt string, relation string, rho_json string")
    got = {}
    for r, t, m in rows(validate.validate(a, e)):
        got.setdefault(r, set()).add((t, m))
    assert got["R1"] == {("z", "unknown type nothing"), ("z", "unknown level W9"), ("m1->no", "missing target no"), ("m1->b", "unknown relation strange")}
    assert got["R2"] == {("m1->b", "extends method>bottleneck")}
    assert got["R3"] == {("m1->m2", "no evidence for extends")}
    assert got["R4"] == {("b->m1", "aggregates_to W1_problem>W3_approach")}
    assert got["R5"] == {("m2", "duplicate of m1")}
    assert got["R6"] == {("m2", "provenance needed for method"), ("n", "provenance needed for numerical")}
    out = {r["node_id"]: r for r in validate.demote(a).collect()}
    assert out["n"]["type"] == "conclusion" and out["n"]["status"] == "demoted" and out["m2"]["status"] == "needs_review" and not out["m1"]["mutated"]


def test_pagerank_tiers_agree(spark):
    arcs = graph.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "d")], "src string, tgt string"))
    seed = spark.createDataFrame([("a", 2.0)], "node_id string, r double")
    one = {r[0]: r[1] for r in graph.pagerank(arcs, seed, rounds=12).collect()}
    many = {r[0]: r[1] for r in graph.pagerank(arcs, seed, rounds=12, one_task_edges=0).collect()}
    assert one == pytest.approx(many) and sum(one.values()) == pytest.approx(1.0)
    assert one["a"] > one["d"] and one["a"] > 0.4


def test_dead_ends_return_to_the_seed(spark):
    arcs = spark.createDataFrame([("a", "b")], "src string, tgt string")
    seed = spark.createDataFrame([("a", 1.0)], "node_id string, r double")
    for limit in (10, 0):
        got = {r[0]: r[1] for r in graph.pagerank(arcs, seed, rounds=30, one_task_edges=limit).collect()}
        assert sum(got.values()) == pytest.approx(1.0) and got["a"] == pytest.approx(2 / 3, abs=1e-6)


def test_components(spark, rows):
    links = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y"), ("a", "b")], "a string, b string")
    assert rows(graph.weak_components(links)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    arcs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, tgt string")
    assert rows(graph.strong_components(arcs)) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert rows(graph.weak_components(links.limit(0))) == []


def test_hausdorff(spark, rows):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 8)), rng.normal(size=(3, 8))
    cos = 1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    want = max(cos.min(1).max(), cos.min(0).max())
    a = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "ia int, va array<double>, k int")
    b = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(y)], "ib int, vb array<double>, k int")
    d = a.join(b, "k").select("k", "ia", "ib", (1 - cosine(F.col("va"), F.col("vb"))).alias("d"))
    assert novelty.hausdorff(d, ["k"]).first()[1] == pytest.approx(want)
    empty = spark.createDataFrame([(0, 0, None), (1, 0, None), (2, 3, 0.4)], "na int, nb int, distance double")
    assert [r[2] for r in novelty.with_empty_sets(empty, "na", "nb").collect()] == [0.0, 1.0, 0.4]


def test_word_hash(spark):
    v = spark.createDataFrame([("Alpha beta alpha",), ("",), (None,)], "x string").select(word_hash(F.col("x")).alias("v")).collect()
    assert sum(x * x for x in v[0][0]) == pytest.approx(1.0) and set(v[1][0]) == {0.0} and (v[2][0] is None or set(v[2][0]) == {0.0})


def test_votes(spark, rows):
    s = spark.createDataFrame([("k", 1, 0.50001), ("k", 2, 0.50002), ("k", 3, 0.7), ("k", 4, None), ("t", 1, 2.0), ("t", 2, 1.0)], "g string, pos int, x double")
    assert rows(vote.vote_scalar(s, ["g"], "x", [F.col("pos")])) == [("k", 0.50001, 2), ("t", 2.0, 1)]
    li = spark.createDataFrame([("k", 1, ["a"]), ("k", 2, ["b", "c"]), ("k", 3, ["d", "e"])], "g string, pos int, x array<string>")
    assert vote.vote_list(li, ["g"], "x", [F.col("pos")]).first()[1] == ["b", "c"]


def test_audit(spark, rows):
    s = spark.createDataFrame([("a", 0.95, 0.01, 0.93), ("b", 0.95, None, 0.55), ("c", None, None, 1.0), ("d", 0.0, None, 0.0)], "node_id string, score double, score_std double, reextracted double")
    assert [(r[0], r[1]) for r in rows(audit.check_i1(s))] == [("a", "passed"), ("b", "failed"), ("c", "skipped"), ("d", "passed")]
    c = spark.createDataFrame([("a", "I1", "failed", False), ("b", "I3", "failed", False), ("c", "I4", "failed", True), ("d", "I2", "skipped", False)], "node_id string, check string, check_status string, soft boolean")
    assert rows(audit.outcome(c)) == [("a", "low_confidence"), ("b", "low_reliability"), ("c", "low_confidence"), ("d", "verified")]


def test_consolidation(spark, rows):
    v = spark.createDataFrame([("g", "a", [1.0, 0.0, 0.0]), ("g", "b", [0.99, 0.01, 0.0]), ("g", "c", [0.0, 1.0, 0.0]), ("h", "d", [1.0, 0.0, 0.0])], "grp string, node_id string, embedding array<double>")
    pairs = consolidate.similar_in_group(v, 0.85)
    assert [r[:3] for r in rows(pairs)] == [("g", "a", "b")]
    assert rows(consolidate.decide(consolidate.clusters(pairs), v)) == [("a", "b")]
    e = spark.createDataFrame([("b", "x", "extends", 0.5), ("a", "b", "extends", 1.0), ("y", "b", "adapts", 0.2), ("y", "a", "adapts", 0.9)], "src string, tgt string, relation string, weight double")
    m = spark.createDataFrame([("b", "a")], "dup_id string, canonical_id string")
    once = consolidate.rewire(e, m).drop("moved")
    assert rows(once) == [("a", "x", "extends", 0.5), ("y", "a", "adapts", 0.9)]
    assert rows(consolidate.rewire(once, m).drop("moved")) == rows(once)


def test_blocks_of_a_group_lose_no_pair(spark, rows, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([("g", f"{i:03}", rng.normal(size=6).tolist()) for i in range(60)], "grp string, node_id string, embedding array<double>")
    want = rows(consolidate.similar_in_group(v, 0.5).select("a", "b"))
    monkeypatch.setattr(consolidate, "BLOCK", 7)
    assert rows(consolidate.similar_in_group(v, 0.5).select("a", "b")) == want and want


def test_store(spark, rows, tmp_path):
    held = spark.createDataFrame([("a", "old", 1, "ctx", None, "src")], "node_id string, name string, version int, context string, provenance string, source_pdf string")
    new = spark.createDataFrame([("a", "new", 2, None, None, "other"), ("b", "b", 1, "c", "p", "s")], held.schema)
    assert rows(store.upsert_atoms(held, new)) == [("a", "new", 2, None, None, "src"), ("b", "b", 1, "c", "p", "s")]
    twice = store.insert_blueprint(held, new.unionByName(new), [F.col("version")])
    assert rows(twice.select("node_id", "name")) == [("a", "old"), ("b", "b")]
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r")], "src string, tgt string, relation string")
    s = store.GraphStore(spark, str(tmp_path / "kb"))
    s.commit(held, e)
    s.commit(store.insert_blueprint(s.atoms, new, [F.col("version")]), store.delete_touching(s.edges, spark.createDataFrame([("c",)], "node_id string")))
    assert rows(s.atoms.select("node_id")) == [("a",), ("b",)] and rows(s.edges) == [("a", "b", "r")]


def test_migration_is_idempotent(spark, rows):
    n = spark.createDataFrame([("a", "paper", "W2_problem_analysis"), ("b", "method", "W3_approach")], "node_id string, type string, level string")
    once = store.migrate(n)
    assert rows(once.select("node_id", "type", "level", "n_changes")) == [("a", "citation", "W1_problem", 2), ("b", "method", "W3_approach", 0)]
    assert store.migrate(once.drop("n_changes")).agg(F.sum("n_changes")).first()[0] == 0


def test_extraction(spark, rows):
    reply = {"W1_problem": {"name": "P", "type": "problem"}, "W2_directions": [{"name": "D", "type": "wrong", "compares_to": ["d", "unknown"], "W3_approaches": [{"name": "A", "type": "method", "context": "c"}]}]}
    a, e = extract.parse_phase1(spark.createDataFrame([("s", json.dumps(reply)), ("t", "no json"), ("u", None)], "source string, reply string"))
    assert rows(a.select("level", "name", "type")) == [("W1_problem", "P", "problem"), ("W2_direction", "D", "method"), ("W3_approach", "A", "method")]
    assert sorted(r[0] for r in e.select("relation").collect()) == ["aggregates_to"] * 2 + ["compares"] + ["decomposes_into"] * 2
    two = {"W4_implementations": [{"name": "I", "parent_W3_id": "a", "extends": ["I", "Other"], "extends_rho": {"bottleneck": "b"}, "W5_code": [{"name": "C", "code_ref": "f.py"}]}]}
    app = a.where("level = 'W3_approach'").select("source", "name", F.lit(0).alias("pos"), F.col("node_id").alias("parent_id"))
    a2, e2 = extract.parse_phase2(spark.createDataFrame([("s", json.dumps(two))], "source string, reply string"), app)
    assert rows(a2.select("level", "type")) == [("W4_implementation", "solution"), ("W5_code", "component")]
    assert e2.where("relation = 'extends' and rho_json is not null").count() == 2


def test_parents_by_prefix_against_brute_force(spark, rows):
    kids = [("s", i, n) for i, n in enumerate(["Alpha", "alp", "alpha beta", "zzz", "", "be"])]
    par = [("s", n, i, f"p{i}") for i, n in enumerate(["alpha b", "ALPHA", "beta", "be", ""])]
    got = rows(extract.resolve_parents(spark.createDataFrame(kids, "source string, child_id int, parent_ref string"), spark.createDataFrame(par, "source string, name string, pos int, parent_id string")))
    want = []
    for _, i, r in kids:
        c = [(0 if r.lower() == n.lower() else 1, p, q) for _, n, p, q in par if r and n and (r.lower().startswith(n.lower()) or n.lower().startswith(r.lower()))]
        want += [(i, min(c)[2])] if c else []
    assert got == sorted(want)


def test_prompts_keep_the_first_characters(spark):
    seg = [("s", i, f"{i}" * 50) for i in range(9)]
    got = extract.prompts(spark.createDataFrame(seg, "source string, pos int, text string"), 200).first()
    assert got["prompt"] == extract.CHUNK_MARK.join(t for _, _, t in seg)[:200] and got["n_segments"] == 9


def test_bundle_round_trip(spark, rows, tmp_path):
    a = spark.createDataFrame([("n1", 'Na "me" [1]', "method", "W3_approach", "ctx: x", "verified", "f.pdf", '["domain:x"]', None, "code()", '{"phase": "x"}'), ("n2", "Two", "concept", "W2_direction", "", "active", None, None, None, None, None)], "node_id string, name string, type string, level string, context string, status string, source_pdf string, tags string, updated_at timestamp_ntz, code_body string, provenance string")
    e = spark.createDataFrame([("n1", "n2", "extends"), ("n1", "gone", "extends")], "src string, tgt string, relation string")
    folder = okf.export(a, e, str(tmp_path / "bundle"))
    (tmp_path / "bundle" / "other.md").write_text("---\ntype: Weird\ntitle: Other\nvendor_level: W1_problem\n---\n\nFirst line\nmore\n\n## Relations\n- likes → [Two](W2_direction/n2.md)\n")
    (tmp_path / "bundle" / "plain.md").write_text("just text")
    got, edges = okf.import_bundle(spark, folder)
    by = {r["node_id"]: r for r in got.collect()}
    assert set(by) == {"n1", "n2", "other", "plain"}
    assert by["n1"]["name"] == 'Na "me" [1]' and by["n1"]["status"] == "verified" and by["n1"]["type"] == "method"
    assert by["other"]["type"] == "concept" and by["other"]["original_type"] == "Weird" and by["other"]["level"] == "W1_problem" and by["other"]["context"] == "First line"
    assert rows(edges) == [("n1", "n2", "extends"), ("other", "n2", "related_to")]


def test_pages_hold_the_whole_graph(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "PAGE_ATOMS", 10)
    a = spark.createDataFrame([(f"n{i:02}", "<b>", "method", "W3_approach", "stuck", "ctx") for i in range(35)], "node_id string, name string, type string, level string, status string, context string")
    e = spark.createDataFrame([(f"n{i:02}", "n00", "extends") for i in range(35)], "src string, tgt string, relation string")
    v = spark.createDataFrame([("a.pdf", "n00", "numerical", "verified", {"I1": "failed"}, 0), ("b.pdf", "n00", "numerical", "verified", {"I1": "passed"}, 1), ("b.pdf", "n01", "concept", "skipped", {}, 1)], "label string, node_id string, type string, status string, checks map<string,string>, pos int")
    index = open(report.write_pages(a, e, str(tmp_path / "pages"), verdicts=v).removeprefix("file://")).read()
    pages = [p.read_text() for p in (tmp_path / "pages").glob("page-*.html")]
    data = [json.loads(p.split("id='graph'>")[1].split("</script>")[0]) for p in pages]
    assert len(pages) == 4 and sum(len(d["nodes"]) for d in data) == 35 and sum(len(d["links"]) for d in data) == 35
    node = next(n for d in data for n in d["nodes"] if n["id"] == "n00")
    assert json.loads(node["checks"]) == {"I1": "passed"} and node["label"] == "&lt;b&gt;" and node["colour"] == report.GREY
    assert "b.pdf" in index and "100 %" in index and "page-000003.html" in index and "failed 0" in index


def test_the_links_of_a_hub_take_several_files(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(okf, "PART_LINES", 7)
    a = spark.createDataFrame([(f"n{i:02}", f"Name {i}", "method", "W3_approach", "", "active", None, None, None, None, None) for i in range(30)], "node_id string, name string, type string, level string, context string, status string, source_pdf string, tags string, updated_at timestamp_ntz, code_body string, provenance string")
    e = spark.createDataFrame([(f"n{i:02}", "n00", "extends") for i in range(1, 30)], "src string, tgt string, relation string")
    folder = okf.export(a, e, str(tmp_path / "bundle"))
    assert len(list((tmp_path / "bundle" / "W3_approach").glob("n00.links-*.md"))) >= 2
    got, edges = okf.import_bundle(spark, folder)
    assert got.count() == 30 and rows(edges) == rows(e)


def test_import_into_a_base(spark, rows, tmp_path):
    f = tmp_path / "bundle" / "W3_approach"
    f.mkdir(parents=True)
    (f / "n1.md").write_text('---\ntype: Odd\ntitle: One\ntags: ["domain:x"]\nvendor_provenance: {"phase": "x"}\n---\n\nText\n\n## Code\n```python\nrun()\n```\n\n## Relations\n- extends → [Two](W3_approach/n2.md)\n')
    (f / "n2.md").write_text("---\ntype: method\ntitle: Two\n---\n\nBody\n")
    (f / "bad.md").write_text("---\n- : [\n---\nx")
    base = store.GraphStore(spark, str(tmp_path / "kb"))
    assert okf.import_into(base, str(tmp_path / "bundle")) == {"atoms_imported": 2, "edges_imported": 1, "concepts_skipped": 1}
    okf.import_into(base, str(tmp_path / "bundle"))
    got = {r["name"]: r for r in base.atoms.collect()}
    assert set(got) == {"One", "Two"} and base.edges.count() == 1
    assert got["One"]["code_body"] == "run()" and json.loads(got["One"]["provenance"]) == {"phase": "x", "original_type": "Odd"} and got["One"]["source_pdf"] == "bundle import"
    assert store.by_domain(base.atoms, "x").count() == 1


def test_offline_model_and_retry(spark):
    p = spark.createDataFrame([("s", "One two. Three four. Five six.")], "source string, prompt string")
    assert providers.ask(p, "source", k=2).count() == 2
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError
        return 7

    assert providers.with_retry(flaky, pause=0.0)() == 7


def test_engine(spark, rows, tmp_path):
    from claimloom import tools
    from claimloom.api import Config, Engine

    eng = Engine(spark, str(tmp_path / "kb"), Config(audit_k=1, consolidate_k=1))
    text = "Agents fail in mazes. Use sparse rewards. Train a critic."
    seen = []
    first = eng.ingest(spark.createDataFrame([(0, text)], "pos int, text string"), "a.pdf", on_progress=lambda stage, pct: seen.append(stage))
    assert first["atoms_inserted"] == 9 and first["edges_inserted"] == 14 and first["atoms_reduced"] == 8 and seen[-1] == "done"
    assert first["levels"] == {"W1_problem": 3, "W2_direction": 4, "W3_approach": 4, "W4_implementation": 4, "W5_code": 2} and first["trajectories"] == 2
    assert first["audit_report"]["n_audited"] == 12 and eng.store.atoms.where("status = 'active'").count() == 0
    up = eng.store.edges.where("relation = 'aggregates_to' and tgt like 'reduced%'")
    assert up.count() == 8
    made = eng.store.atoms.where("node_id like 'reduced_W4%'").first()
    assert made["code_body"] and json.loads(made["provenance"])["phase"] == "reduce" and made["embedding"]
    again = eng.ingest(spark.createDataFrame([(0, text)], "pos int, text string"), "a.pdf")
    assert again["atoms_inserted"] == 0 and again["edges_inserted"] == 0
    before = len(eng.store._state()["atoms"])
    eng.config.auto_consolidate = False
    eng.ingest(spark.createDataFrame([(0, "Boats sink in storms. Steer by stars. Learn the tides.")], "pos int, text string"), "z.pdf")
    assert len(eng.store._state()["atoms"]) == before + 1 and eng.store.atoms.groupBy("node_id").count().where("count > 1").isEmpty()
    found = tools.call(eng, "search", {"query": "critic", "level": "W3"})["result"]
    assert {"context", "source_pdf", "status"} <= set(found[0])
    said = tools.call(eng, "evaluate_novelty", {"proposal_text": text})["result"]
    assert set(said["level_distances"]) == set(O.LEVELS) and said["most_similar_trajectory"]["w5"].startswith("w5_")
    assert eng.store.atoms.where("source_pdf = '__proposal__'").count() == 0
    assert tools.call(eng, "get_schema", {})["result"]["types"] == O.TYPES and "error" in tools.call(eng, "search", {})


def test_several_sources_and_consolidation(spark, tmp_path):
    from claimloom.api import Config, Engine

    eng = Engine(spark, str(tmp_path / "kb"), Config(audit_k=1, consolidate_k=1))
    text = "Agents fail in mazes. Use sparse rewards. Train a critic."
    out = eng.ingest(spark.createDataFrame([("a.pdf", 0, text), ("b.pdf", 0, text)], "source string, pos int, text string"))
    # the refinement has merged what the two sources have in common
    assert out["refine_log"]["errors_found"][0] > 0 and out["refine_log"]["errors_fixed"][-1] > 0
    later = eng.ingest(spark.createDataFrame([(0, text)], "pos int, text string"), "c.pdf")
    assert later["consolidate_report"]["atoms_merged"] >= 1 and "W1_problem" in later["consolidate_report"]["levels_processed"]
    merged = eng.store.atoms.where("status = 'merged'").collect()
    kept = json.loads(eng.store.atoms.where(F.col("node_id") == json.loads(merged[0]["provenance"])["merged_into"]).first()["provenance"])
    assert merged[0]["node_id"] in kept["merged_from"] and kept["phase"] == "consolidate"


def test_only_active_atoms_are_audited(spark, rows):
    cols = "node_id string, type string, status string, context string, code_body string, provenance string"
    a = spark.createDataFrame([("n", "numerical", "active", "got 0.90 now", None, '{"score": 0.9}'), ("bad", "numerical", "active", "got 0.10", None, '{"score": "about 3"}'), ("off", "numerical", "active", "got 0.10", None, '{"score": 0.9}'), ("old", "numerical", "verified", "got 0.10", None, '{"score": 0.9}'), ("c", "citation", "active", "", None, '{"raw_citation": "K"}'), ("p", "problem", "active", "", None, None), ("m", "method", "active", "", None, "x"), ("e", "experiment", "active", "assert", None, None), ("k", "component", "skipped", "return", None, None)], cols)
    e = spark.createDataFrame([("m", "k", "decomposes_into")], "src string, tgt string, relation string")
    cat = spark.createDataFrame([("K", '{"doi":"1"}')], "key string, resolved string")
    after, report_, per = audit.verify(a, e, catalogue=cat, k=1)
    got = {r["node_id"]: r for r in after.collect()}
    assert {n: r["status"] for n, r in got.items()} == {"n": "verified", "bad": "verified", "off": "low_confidence", "old": "verified", "c": "verified", "p": "skipped", "m": "verified", "e": "verified", "k": "skipped"}
    assert json.loads(got["c"]["provenance"]) == {"raw_citation": "K", "resolved": {"doi": "1"}}
    r = report_.first()
    assert (r["n_audited"], r["n_passed"], r["n_failed"], r["n_skipped"]) == (6, 5, 1, 1)
    checks = {x["node_id"]: x["checks"] for x in per.collect()}
    assert checks["off"] == {"I1": "failed"} and checks["e"] == {"I2": "skipped"} and checks["p"] == {} and "old" not in checks
    with_spec = audit.verify(a, e, spec={"task_name": "t"}, k=3)[2]
    assert {x["node_id"]: x["checks"] for x in with_spec.collect()}["e"] == {"I2": "passed"}


def test_replies_of_the_services(spark):
    feed = "<feed><entry><id>http://arxiv.org/abs/1706.03762v5</id><title>Attention\n Is All</title><published>2017-06-12T17:57:34Z</published><author><name>A. V</name></author></entry></feed>"
    rows_ = [
        ("a", "some paper", json.dumps({"data": [{"title": "T", "authors": [{"name": f"N{i}"} for i in range(9)], "year": 2017, "venue": "V", "externalIds": {"DOI": "10.1/x"}}]}), feed, None, None),
        ("b", "arXiv:1706.03762", json.dumps({"data": []}), feed, None, None),
        ("c", "some paper", None, feed, None, None),
        ("d", "x", None, "<feed></feed>", json.dumps({"results": [{"title": "O", "doi": "https://doi.org/10.2/y", "authorships": [{"author": {"display_name": "P"}}], "publication_year": 2020, "primary_location": None}]}), None),
        ("e", "x", "no json", None, json.dumps({"results": []}), json.dumps({"message": {"items": [{"DOI": "10.3/z", "title": ["C"], "author": [{"given": "Q", "family": "R"}, {"family": "S"}], "issued": {"date-parts": [[2021]]}, "container-title": ["J"]}]}})),
        ("f", " ", json.dumps({"data": [{"title": "T"}]}), None, None, None),
        ("g", "x", None, None, None, None),
    ]
    df = spark.createDataFrame(rows_, "id string, raw_citation string, semantic_scholar string, arxiv string, openalex string, crossref string")
    got = {r["id"]: r["resolved"] and r["resolved"].asDict() for r in providers.resolve_replies(df).collect()}
    assert got["a"]["source_api"] == "semantic_scholar" and got["a"]["authors"] == [f"N{i}" for i in range(5)] and got["a"]["doi"] == "10.1/x" and got["a"]["confidence"] == 0.9
    assert got["b"]["source_api"] == "arxiv" and got["b"]["confidence"] == 0.85 and got["b"]["title"] == "Attention Is All" and got["b"]["year"] == 2017 and got["c"]["confidence"] == 0.6
    assert got["d"]["source_api"] == "openalex" and got["d"]["doi"] == "10.2/y" and got["d"]["venue"] is None
    assert got["e"]["source_api"] == "crossref" and got["e"]["authors"] == ["Q R", "S"] and got["e"]["year"] == 2021 and got["e"]["venue"] == "J"
    assert got["f"] is None and got["g"] is None
    asked = df.select(providers.service_query("arxiv", F.col("raw_citation")).alias("q")).collect()
    assert asked[0]["q"] == "ti:some+paper" and asked[1]["q"] == "id_list=1706.03762"


def test_fixes_of_a_model(spark, rows):
    from claimloom.operators import refine

    replies = spark.createDataFrame([("s", json.dumps({"fixes": [{"action": "update_atom", "node_id": "a", "type": "concept", "provenance": {"x": 1, "y": 1}}, {"action": "update_atom", "node_id": "a", "type": "method", "provenance": {"y": 2}}, {"action": "update_edge", "src": "a", "tgt": "b", "relation": "adapts", "rho": {"mechanism": "m"}}, {"action": "remove_edge", "src": "b", "tgt": "a"}, {"action": "other"}]})), ("t", "no json")], "source string, reply string")
    up, eup, gone = refine.parse_fixes(replies)
    a = spark.createDataFrame([("a", "wrong", "W3_approach", "c", '{"z": 0}'), ("b", "method", "W3_approach", "c", None)], "node_id string, type string, level string, context string, provenance string")
    fixed = {r["node_id"]: r for r in validate.apply_atom_updates(a, up).collect()}
    assert fixed["a"]["type"] == "method" and json.loads(fixed["a"]["provenance"]) == {"z": 0, "x": 1, "y": 2} and fixed["b"]["provenance"] is None
    e = spark.createDataFrame([("a", "b", "extends", None), ("a", "b", "improves", None), ("b", "a", "extends", None)], "src string, tgt string, relation string, rho_json string")
    assert [(r["relation"], json.loads(r["rho_json"])) for r in validate.apply_edge_actions(e, eup, gone).collect()] == [("adapts", {"mechanism": "m"})] * 2


def test_commits_append_and_conflict(spark, rows, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "kb"))
    a = spark.createDataFrame([("a", 1)], "node_id string, version int")
    e = spark.createDataFrame([("a", "b", "r")], "src string, tgt string, relation string")
    first = s.commit(a, e)
    s.append(spark.createDataFrame([("b",)], "node_id string"))
    assert rows(s.atoms) == [("a", 1), ("b", None)] and rows(s.edges) == [("a", "b", "r")] and rows(s.read("atoms", first)) == [("a", 1)]
    with pytest.raises(store.Conflict):
        s.append(a, since=first)
    assert s.versions() == [1, 2] and rows(s.atoms.select("node_id")) == [("a",), ("b",)]
    s.commit(s.atoms.where("node_id = 'b'"), e)
    assert s.vacuum(keep=1) >= 2 and rows(s.atoms.select("node_id")) == [("b",)] and s.versions() == [3]


def test_texts_of_pdf_files(spark, rows, tmp_path):
    from claimloom.sources import pdf

    (tmp_path / "one.pdf").write_bytes(b"p1|p2")
    (tmp_path / "bad.pdf").write_bytes(b"")
    got = pdf.read_pages(spark, str(tmp_path), lambda content: content.decode().split("|") if content else 1 / 0)
    assert rows(got.select("pos", "text")) == [(0, "p1"), (1, "p2")]


def test_the_last_problem_counts(spark, rows):
    df = spark.createDataFrame([("s", "a", 1), ("s", "b", 3), ("s", "c", None)], "source string, name string, pos int")
    assert rows(novelty.last_wins(df, ["source"], [F.col("pos")])) == [("s", "b", 3)]


def test_hausdorff_to_a_set_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(novelty, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 8)), rng.normal(size=(3, 8))
    cos = 1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    a = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    b = spark.createDataFrame([(7, v.tolist()) for v in y], "k int, v array<double>")
    assert novelty.hausdorff_to(b, "k", a).first()["distance"] == pytest.approx(max(cos.min(1).max(), cos.min(0).max()))
    assert novelty.hausdorff_to(b, "k", a.limit(0)).count() == 0


def test_best_ancestor_is_found_at_any_distance(spark, rows):
    chain = [(f"n{i}", f"n{i + 1}", "aggregates_to") for i in range(40)] + [("n1", "n0", "decomposes_into"), ("n40", "x", "aggregates_to"), ("n40", "w", "aggregates_to"), ("x", "n40", "decomposes_into")]
    e = spark.createDataFrame(chain, "src string, tgt string, relation string")
    a = spark.createDataFrame([("n0", "W5_code"), ("n1", "W5_code"), ("x", "W4_implementation"), ("w", "W4_implementation")], "node_id string, level string")
    seeds = a.where("level = 'W5_code'")
    arcs = {(s, t) for s, t, _ in chain}
    names = sorted({x for arc in arcs for x in arc})
    m = np.zeros((len(names), len(names)))
    for s, t in arcs:
        m[names.index(t), names.index(s)] = 0.5 / sum(s == u for u, _ in arcs)
    for limit in (1000, 0):
        assert [r[:2] for r in rows(graph.best_ancestors(e, a, seeds, "W4_implementation", one_task_edges=limit))] == [("n0", "w"), ("n1", "w")]
        near = a.union(spark.createDataFrame([("n2", "W3_approach")], a.schema))
        got = {r["seed"]: r["score"] for r in graph.best_ancestors(e, near, seeds, "W3_approach", one_task_edges=limit).collect()}
        want = {s: 0.5 * np.linalg.inv(np.eye(len(names)) - m)[names.index("n2"), names.index(s)] for s in ("n0", "n1")}
        assert got == pytest.approx(want, abs=6e-7)


def test_trajectories_reach_levels_further_up(spark, rows):
    e = spark.createDataFrame([("c", "c2", "aggregates_to"), ("c2", "i", "aggregates_to"), ("i", "d", "aggregates_to"), ("a", "i", "decomposes_into"), ("d", "a", "aggregates_to"), ("a", "p", "aggregates_to"), ("p", "d", "decomposes_into")], "src string, tgt string, relation string")
    levels = {"c": O.LEVELS[4], "c2": O.LEVELS[4], "i": O.LEVELS[3], "a": O.LEVELS[2], "d": O.LEVELS[1], "p": O.LEVELS[0], "alone": O.LEVELS[4]}
    a = spark.createDataFrame([(n, lv, "active") for n, lv in levels.items()], "node_id string, level string, status string")
    assert rows(graph.trajectories(e, a, ["active"])) == [("alone", None, None, None, None), ("c", "i", "a", "d", "p"), ("c2", "i", "a", "d", "p")]


def test_ways_up_and_down_have_no_last_step(spark, rows):
    up = [(f"n{i:02}", f"n{i + 1:02}", "aggregates_to", 1.0) for i in range(20)] + [("n00", "n00", "aggregates_to", 9.0), ("n20", "on", "aggregates_to", 1.0)]
    ring = [("r0", "r1", "aggregates_to", 1.0), ("r1", "r2", "aggregates_to", 1.0), ("r2", "r1", "aggregates_to", 1.0)]
    e = spark.createDataFrame(up + ring, "src string, tgt string, relation string, weight double")
    a = spark.createDataFrame([("n20", O.LEVELS[1])], "node_id string, level string")
    starts = spark.createDataFrame([("n00",), ("r0",)], "node_id string")
    assert rows(graph.upward_trace(e, a, starts, O.LEVELS[1])) == sorted([("n00", i, f"n{i:02}") for i in range(21)] + [("r0", i, f"r{i}") for i in range(3)], key=lambda r: (r[0], str(r[1]), r[2]))
    down = [(f"d{i:02}", f"d{i + 1:02}", "decomposes_into") for i in range(66)] + [("d66", "d00", "decomposes_into")]
    got = graph.downward_expand(spark.createDataFrame(down, "src string, tgt string, relation string"), a, spark.createDataFrame([("d00",)], "node_id string"), O.LEVELS[1])
    assert got.count() == 67


def test_rewiring_keeps_the_evidence(spark, rows):
    e = spark.createDataFrame([("a", "b", "extends", 1.0, None), ("a", "b2", "extends", 2.0, "why"), ("c", "d", "extends", 1.0, "kept")], "src string, tgt string, relation string, weight double, rho_json string")
    m = spark.createDataFrame([("b2", "b")], "dup_id string, canonical_id string")
    assert rows(consolidate.rewire(e, m).select("src", "tgt", "weight", "rho_json")) == [("a", "b", 1.0, "why"), ("c", "d", 1.0, "kept")]


def test_consolidate_keeps_the_evidence_of_the_store(spark, rows, tmp_path):
    from claimloom.api import Engine

    eng = Engine(spark, str(tmp_path / "kb"))
    a = spark.createDataFrame([(n, n, "method", O.LEVELS[2], "", "active") for n in ("a", "b")], "node_id string, name string, type string, level string, context string, status string")
    eng.store.commit(a, spark.createDataFrame([("a", "b", "extends", 1.0, "why")], "src string, tgt string, relation string, weight double, rho_json string"))
    eng.consolidate()
    assert [r["rho_json"] for r in eng.store.edges.collect()] == ["why"]


def test_arxiv_ids_come_from_whole_texts(spark, rows, tmp_path):
    from claimloom.queries import analytics

    texts = [(1, "arXiv:1234.00001v2 a"), (2, "long before it " * 50 + "see https://arxiv.org/abs/2101.12345v3."), (3, "no id"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["arxiv_id"] for r in analytics.arxiv_id_extract(spark, str(tmp_path)).collect()}
    assert got == {1: "1234.00001v2", 2: "2101.12345v3", 3: "", 4: None}
