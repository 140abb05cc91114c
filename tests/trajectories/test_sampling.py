"""Samples of exact size and stratified splits."""

import pytest
from pyspark.sql import functions as F

from trajspark.operators import sampling


@pytest.mark.parametrize("k", [0, 1, 777, 4_999, 5_000, 9_999])
def test_exact_size_in_every_partitioning(spark, k):
    df = spark.range(5_000).withColumn("v", F.col("id") % 7)
    first = sorted(r.id for r in sampling.subsample(df.repartition(3), k, ["id"]).collect())
    again = sorted(r.id for r in sampling.subsample(df.repartition(11, "v"), k, ["id"]).collect())
    assert first == again and len(first) == len(set(first)) == min(k, 5_000)
    order = [r.id for r in df.orderBy(sampling.hash_of(["id"], 42), "id").limit(k).collect()]
    assert first == sorted(order)


def test_seeds_differ_and_rows_may_repeat(spark):
    df = spark.range(100)
    ids = lambda d, s: {r.id for r in sampling.subsample(d, 20, ["id"], seed=s).collect()}
    assert ids(df, 1) != ids(df, 2)
    same = spark.range(50).select(F.lit(None).cast("long").alias("id"), F.lit("x").alias("t"))
    assert sampling.subsample(same, 20, ["id"]).count() == 20
    assert sampling.subsample(df.limit(0), 20, ["id"]).count() == 0


def test_stratified_shares_are_exact(spark):
    df = spark.range(1_000).withColumn("label", (F.col("id") % 10 == 0).cast("long"))
    got = {(r.label, r.is_train): r["count"] for r in sampling.stratified(df, ["id"], share=0.75).groupBy("label", "is_train").count().collect()}
    assert got == {(0, True): 675, (0, False): 225, (1, True): 75, (1, False): 25}
