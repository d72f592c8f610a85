"""Plans of basket joins."""

from pyspark.sql import functions as F

from lumenstat.operators import baskets


def test_baskets_of_a_frequent_item_stay_where_they_are(spark):
    """Rules were joined to baskets by item, all baskets of an item in one task."""
    items = spark.range(40).select((F.col("id") % 10).alias("txn"), (F.col("id") % 4).cast("string").alias("item")).distinct()
    rules = spark.createDataFrame([("0", "2"), ("1", "3")], "lhs string, rhs string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = baskets.evaluated(rules, items)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin [item") == 2 and {tuple(r) for r in got.collect()} == {("0", "2", 0.5, 1.0), ("1", "3", 0.5, 1.0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
