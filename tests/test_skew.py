import pytest

from claimloom.plans import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(60)] + [(None, -1), (None, -2)], "k string, v int")
    small = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k3", "c"), ("zz", "d"), (None, "n")], "k string, w string")
    assert rows(skew.salted_join(big, small, ["k"], how, total=62)) == rows(big.join(small, ["k"], how))


def test_hot_keys_are_bounded(spark):
    big = spark.range(100_000).selectExpr("cast(id % 300 as string) as k")
    assert skew.hot_keys(big, ["k"], 100_000).count() == 0
    assert skew.hot_keys(big.withColumn("k", big["k"].substr(1, 0)), ["k"], 100_000).count() == 1
