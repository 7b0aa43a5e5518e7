from pyspark.sql import functions as F

from claimloom.operators.orphans import orphan_references, orphan_report

E = "src string, tgt string, relation string, created_at timestamp_ntz, id string, kind string"
N = "node_id string, created_at timestamp_ntz, id string"


def frames(spark, e, n, d):
    return spark.createDataFrame([(*x, "c", "c") for x in e], E.replace("timestamp_ntz", "string")).withColumn("created_at", _ts()), spark.createDataFrame([(*x, "c") for x in n], N.replace("timestamp_ntz", "string")).withColumn("created_at", _ts()), spark.createDataFrame(d, "node_id string, deleted_at string")


def _ts():
    return F.col("created_at").cast("timestamp_ntz")


def test_kinds(spark, rows):
    e = [("a", "gone", "r", "2022-01-05"), ("a", "never", "r", "2022-01-06"), ("late", "a", "r", "2022-02-01"), ("late", "a", "r2", None), ("late", "a", "r3", "2023-01-01"), (None, "never", "r", "2022-01-06"), (" ", "a", "r", None), ("a", "never", "r", "2022-01-06"), ("back", "a", None, "2022-01-01")]
    n = [("a", "2021-01-01"), ("a", "2021-01-01"), ("late", "2022-06-01"), ("back", None), (None, None)]
    d = [("gone", "x"), ("gone", "x"), ("back", "x"), (None, None)]
    found = orphan_references(*frames(spark, e, n, d))
    assert rows(found.drop("created_at")) == [(None, "never", "r", "tgt", "missing"), ("a", "gone", "r", "tgt", "deleted"), ("a", "never", "r", "tgt", "missing"), ("late", "a", "r", "src", "late")]
    assert rows(orphan_report(cc_edges=found)) == [("cc_edges", "src", "late", "2022-02", 1), ("cc_edges", "tgt", "deleted", "2022-01", 1), ("cc_edges", "tgt", "missing", "2022-01", 2)]


def test_empty_tables(spark, rows):
    assert rows(orphan_references(*frames(spark, [], [], []))) == []
    assert len(rows(orphan_references(*frames(spark, [("a", "b", "r", None)], [], [])))) == 2


def test_frequent_key_is_salted(spark, monkeypatch):
    from claimloom.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    e = [(f"s{i}", "hub", "r", "2022-01-01") for i in range(50)]
    assert orphan_references(*frames(spark, e, [(f"s{i}", "2021-01-01") for i in range(50)], [])).count() == 50


def test_decisions_and_report_per_table(spark, rows):
    from claimloom.operators.orphans import orphan_decisions

    _, n, d = frames(spark, [("a", "b", "r", None)], [("a", "2021-01-01"), ("late", "2022-06-01")], [("gone", "x")])
    m = spark.createDataFrame([(1, "a", ["gone", None, " ", "never", "never"], None, "2022-01-05"), (1, "a", ["gone", None, " ", "never", "never"], None, "2022-01-05"), (2, "late", None, "a", "2022-02-01"), (3, None, [], "gone", None)], "decision_id long, canonical_id string, dup_ids array<string>, parent_id string, decided_at string").withColumn("decided_at", F.col("decided_at").cast("timestamp_ntz"))
    got = orphan_decisions(m, n, d)
    assert rows(got.select("decision_id", "id", "side", "orphan_kind")) == [(1, "gone", "dup_ids", "deleted"), (1, "never", "dup_ids", "missing"), (2, "late", "canonical_id", "late"), (3, "gone", "parent_id", "deleted")]
    assert ("merge_decisions", "parent_id", "deleted", "unknown", 1) in rows(orphan_report(merge_decisions=got))
    assert rows(orphan_report(merge_decisions=orphan_decisions(m.limit(0), n, d))) == []
