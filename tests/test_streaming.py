from datetime import datetime, timedelta

from pyspark.sql import functions as F

from labelweave.functions import scalar
from labelweave.streaming import event_labels


def test_finished_windows_are_counted_once(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=k), k % 3, "view" if k % 2 else "click", 1.0, None) for k in range(240)]
    for part in range(4):
        spark.createDataFrame(rows[part * 60 : part * 60 + 60], event_labels.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    counts = event_labels.window_counts(event_labels.read_events(spark, f"{tmp_path}/in"))
    event_labels.write_counts(counts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = spark.createDataFrame(rows, event_labels.EVENTS).groupBy("user_id", "event_type", F.window("ts", "1 day").start.alias("start")).count()
    both = got.join(batch, (got.gene == batch.user_id) & (got.label == batch.event_type) & (got.start == batch.start))
    assert both.count() == got.count() > 0 and both.where("n <> count").count() == 0


def test_scalar_functions(spark):
    df = spark.createDataFrame([(float("nan"), [0.0, 1.0], [1.0, 1.0]), (float("inf"), [0.0], [0.0]), (2.0, [], [])], "v double, x array<double>, y array<double>")
    rows = df.select(scalar.nan_to_zero(F.col("v")).alias("v"), scalar.hassanat(F.col("x"), F.col("y")).alias("d"), scalar.scaled_sigmoid(F.lit(0.5)).alias("s")).collect()
    assert [r["v"] for r in rows] == [0.0, 0.0, 2.0] and [r["d"] for r in rows] == [0.5, 0.0, 0.0] and rows[0]["s"] == 1.0
