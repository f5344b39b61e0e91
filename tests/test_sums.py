"""Results that do not depend on how rows are dealt to tasks."""

import duckdb
from pyspark.sql import functions as F

from rankframe import plans


def test_floored_means_do_not_depend_on_the_order_of_the_sum(spark, tmp_path):
    """Customers whose mean is a whole number: the last bit of the sum decides the floor."""
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    whole = orders.groupBy("o_custkey").agg(cents.alias("c"), F.count("*").alias("n")).where(F.col("c") % (100 * F.col("n")) == 0)
    orders = orders.join(F.broadcast(whole.select("o_custkey")), "o_custkey", "left_semi")
    one = f"{tmp_path}/one.parquet"
    orders.coalesce(1).orderBy("o_orderkey").write.parquet(one)
    orders.withColumn("x", F.xxhash64("o_orderkey")).repartition(7, "x").sortWithinPartitions(F.desc("o_orderkey")).drop("x").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.sql("SET threads = 1")
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{one}/*.parquet'")
    want = sorted(duck.sql(plans.oracles()["a20_order_statistics"]).fetchall())
    assert sorted(map(tuple, plans.queries()["a20_order_statistics"](spark, str(tmp_path)).collect())) == want and len(want) > 20
