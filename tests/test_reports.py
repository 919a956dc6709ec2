"""global_rank on data large enough that range partitioning samples its bounds."""

from pyspark.sql import functions as F

from brandlens.operators.reports import global_rank


def test_global_rank_large_matches_arithmetic(spark):
    n = 300_000
    # keys in scrambled order over many input partitions; a third of rows share one value
    # a payload column the per-partition count does not need, as in real rows
    df = spark.range(0, n, numPartitions=12).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") * 7919 % n).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    r = global_rank(df, [F.col("k").asc(), F.col("id").asc()], num_partitions=16)
    expected = df.select("id", "k").toPandas().sort_values(["k", "id"]).reset_index(drop=True)
    expected["rnk"] = expected.index + 1
    got = r.select("id", "rnk", "payload").toPandas().set_index("id").sort_index()
    assert (got["rnk"].values == expected.set_index("id").sort_index()["rnk"].values).all()


def test_global_rank_default_partitions(spark):
    df = spark.range(0, 50_000, numPartitions=6).select(
        F.col("id"), (F.col("id") * 7919 % 50_000).alias("k"), F.col("id").cast("string").alias("payload"))
    r = global_rank(df, [F.col("k").desc(), F.col("id").asc()])
    got = {row.id: row.rnk for row in r.select("id", "rnk", "payload").collect()}
    order = sorted(range(50_000), key=lambda i: (-(i * 7919 % 50_000), i))
    assert all(got[i] == pos + 1 for pos, i in enumerate(order))
