import random
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from claimloom.llm import components, formatdup, survivors
from claimloom.plans import skew

DECISIONS = "do_merge boolean, canonical_id string, dup_ids array<string>, group_id string, hi string"


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in parent if find(x) != x)


def test_star_groups_against_union_find(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(150):03}", f"n{rnd.randrange(150):03}") for _ in range(110)]
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i:03}") for i in range(300)]
    links = components.canonical(spark.createDataFrame(pairs + pairs, "a string, b string"))
    assert rows(components.star_groups(links)) == brute([p for p in pairs if p[0] != p[1]])


def test_decisions(spark, rows):
    d = spark.createDataFrame([(True, "b", ["a", None, " ", "b", "a"], "", ""), (False, "b", ["z"], "", ""), (None, "b", ["z"], "", ""), (True, "", ["q"], "", ""), (True, "x", None, "", ""), (True, "x", [], "", ""), (True, "c", ["b"], "", "")], DECISIONS)
    assert rows(components.groups_of_decisions(d)) == [("a", "b"), ("a", "c")]
    assert rows(components.groups_of_decisions(d.limit(0))) == []


NODES = "node_id string, version int, updated_at timestamp_ntz, context string, code_ref string, code_body string, source_pdf string, group_id string, member_id string"


def test_survivors(spark, rows):
    from datetime import datetime as T

    g = spark.createDataFrame([("a", "b"), ("a", "c")], "group_id string, member_id string")
    n = [
        ("a", 1, T(2020, 1, 1), "old", None, "n/a", "x", "", ""),
        ("b", 2, None, "newer", "N/A ", None, None, "", ""),
        ("c", 2, T(2019, 1, 1), "newest", " ", "TBD", "unknown", "", ""),
        ("c", 2, T(2019, 1, 1), "newest", " ", "TBD", "unknown", "", ""),
        ("z", 9, T(2022, 1, 1), "other", "r", "b", "p", "", ""),
        ("b", None, T(2022, 1, 1), "lowest", "ref", None, None, "", ""),
        (None, 3, None, "no id", None, None, None, "", ""),
    ]
    df = spark.createDataFrame(n, NODES)
    assert rows(survivors.field_winners(df, g)) == [("a", "code_ref", "b"), ("a", "context", "c"), ("a", "source_pdf", "a")]
    assert rows(survivors.survivors(df, g)) == [("a", "newest", "ref", None, "x")]
    assert rows(survivors.field_winners(df.limit(0), g)) == []


def test_rank_by_completeness_and_trust(spark, rows):
    from datetime import datetime as T

    g = spark.createDataFrame([("a", "b"), ("a", "c")], "group_id string, member_id string")
    n = [("a", 1, T(2020, 1, 1), "full", "r", None, None, "low_confidence"), ("b", 9, T(2023, 1, 1), "late", None, None, None, "odd"), ("c", 1, T(2019, 1, 1), "trusted", "s", None, None, "Verified")]
    df = spark.createDataFrame(n, NODES.replace("group_id string, member_id string", "status string"))
    assert rows(survivors.field_winners(df, g, rank=["completeness", "trust"])) == [("a", "code_ref", "c"), ("a", "context", "c")]
    assert rows(survivors.field_winners(df, g, rank=["completeness", "recency"])) == [("a", "code_ref", "a"), ("a", "context", "a")]
    assert rows(survivors.field_winners(df, g)) == [("a", "code_ref", "a"), ("a", "context", "b")]


def test_long_values_and_ties(spark, rows):
    g = spark.createDataFrame([("a", "b")], "group_id string, member_id string")
    long = "x" * 300_000
    df = spark.createDataFrame([("b", 1, None, long, None, None, None, "", ""), ("a", 1, None, "short", None, None, None, "", "")], NODES)
    assert rows(survivors.field_winners(df, g)) == [("a", "context", "a")]


def test_payload_notations(spark):
    p = ['{"Name": "A \\"b\\" | x=1", "type": "t", "LEVEL": null}', "Type: t\nname: a: b\nlevel: W1", "level=W1|name = a b | type=t", "", None, "{broken", '"name": "q"']
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "i string, payload string")
    got = [r["n"] for r in df.select(formatdup.payload_field(F.col("payload"), "name").alias("n")).collect()]
    assert got[0] == 'A "b" | x=1' and got[1] == "a: b" and got[2].strip() == "a b" and got[3] is None and got[4] is None and got[5] is None


def key(x):
    return regex.sub(r"[^\p{L}\p{Nd}]", "", (x or "").upper().lower().replace("ς", "σ"))


def test_refine_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 15)
    rnd = random.Random(5)
    names = ["Straße eins", "STRASSE-EINS", "abc", "a.b.c", "cab", "ab c", "abd", None, "", "?", "名 前", "名前", "a" * 50_000]
    recs = [(f"r{i:03}", rnd.choice(names), rnd.choice(["method", " Method.", None]), rnd.choice(["W1", "w-1"])) for i in range(160)]
    recs += [("x1", None, None, "--"), ("x2", "", " ", None)]
    df = spark.createDataFrame([(*r, 1) for r in recs], "id string, name string, type string, level string, k1 int")
    groups = defaultdict(set)
    for i, *f in recs:
        if any(map(key, f)):
            groups[tuple(map(key, f))].add(i)
    want = sorted((min(v), x) for v in groups.values() for x in v if x != min(v))
    found = formatdup.refine(df)
    assert rows(found) == want
    assert sum(r[1] for r in rows(formatdup.copies_of(found))) == len(want) + len({a for a, _ in want})
    assert rows(formatdup.refine(df.limit(0))) == []
