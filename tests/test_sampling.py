import hashlib

import pytest
from pyspark.sql import functions as F

from grovemark.operators import sampling


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def in_order(values, seed):
    return sorted(values, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [0, 1, 137, 1000])
def test_exact_sample_whatever_the_partitioning(spark, n):
    df = spark.range(1000)
    want = sorted(in_order(range(1000), 5)[:n])
    assert ids(sampling.sample_exact(df.repartition(3), "id", n, 5)) == want
    assert ids(sampling.sample_exact(df.repartition(11), "id", n, 5)) == want


def test_sample_larger_than_the_table_fails(spark):
    with pytest.raises(Exception, match="larger than the table"):
        sampling.sample_exact(spark.range(10), "id", 11).collect()


def test_per_class_quotas(spark):
    df = spark.range(900).withColumn("c", F.when(F.col("id") < 600, "hot").when(F.col("id") < 700, "b").otherwise("c"))
    got = sampling.sample_per_class(df, "id", "c", {"hot": 20, "b": None, "c": 0}).groupBy("c").count()
    assert {r["c"]: r["count"] for r in got.collect()} == {"hot": 20, "b": 100}


def test_quota_above_class_size_takes_all(spark):
    df = spark.range(30).withColumn("c", F.lit("a"))
    assert sampling.sample_per_class(df, "id", "c", {"a": 50}).count() == 30


def test_balanced_subset(spark):
    got = sampling.balanced_subset(spark.range(500), "id", F.col("id") < 40, 30)
    assert got.filter("id < 40").count() == 30 and got.count() == 60


def test_split_rounds_the_test_part_up(spark):
    split = sampling.split_train_test(spark.range(11), "id", 0.5).collect()
    assert sum(r.is_test for r in split) == 6 and len(split) == 11


def test_bernoulli_share(spark):
    assert 0.18 < sampling.bernoulli_sample(spark.range(20_000), "id", 0.2).count() / 20_000 < 0.22


def test_dense_ids_follow_the_key(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 1237 % 5003).alias("k")).repartition(5)
    got = sorted((r.k, r.n) for r in sampling.dense_ids(df, ["k"], "n", start=10).collect())
    assert [n for _, n in got] == list(range(10, 10 + len(got)))
