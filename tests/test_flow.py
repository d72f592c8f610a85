import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstat.operators.smooth import AdditiveSplines
from lumenstat.sources import scans
from lumenstat.streaming.windows import window_moments


def test_csv_null_mark(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,?\n2,3.5\n")
    rows = scans.csv(spark, str(tmp_path / "x.csv"), "a int, b double").orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, None), (2, 3.5)]


def test_draws_do_not_depend_on_partitions(spark):
    k = F.col("id")
    make = lambda df: df.select("id", scans.normal(k, 1).alias("z"), scans.uniform(k, 2).alias("u"))
    assert make(spark.range(500, numPartitions=1)).exceptAll(make(spark.range(500, numPartitions=4))).isEmpty()
    u = make(spark.range(20000)).agg(F.avg("u"), F.avg("z"), F.stddev("z"), F.min("u"), F.max("u")).first()
    assert np.allclose(u[:3], [0.5, 0, 1], atol=0.02) and 0 < u[3] < u[4] < 1


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = window_moments(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("window_moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("window_moments").select("start", "event_type", "n")
    assert got.exceptAll(window_moments(events).select("start", "event_type", "n")).isEmpty() and got.count() > 0


def test_splines_fit_a_kink_and_shrink_to_a_line(spark):
    df = spark.range(200).select((F.col("id") / 20).alias("x"), (F.col("id") % 7).cast("double").alias("v")).withColumn("y", F.abs(F.col("x") - 5) + 2 * F.col("v"))
    fit = AdditiveSplines(df, {"x": [5.0], "v": []}, "y", 0.0)
    assert fit.rss == pytest.approx(0, abs=1e-6) and fit.df == pytest.approx(4)
    assert df.agg(F.max(F.abs(F.col("y") - fit.predict()))).first()[0] < 1e-6
    assert AdditiveSplines(df, {"x": [5.0], "v": []}, "y", 1e12).df == pytest.approx(3, abs=1e-3)
