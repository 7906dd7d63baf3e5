import numpy as np
from pyspark.sql import functions as F

from sparkchemo.operators.projection import Ellipse
from sparkchemo.sources.tables import csv_table, load_model, npy_table, save_model, write_dataset
from sparkchemo.streaming.scoring import outlier_rates, run_to_memory, stream_table


def test_csv_with_skipped_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text("# a comment\nName A B\n'p q' 1.5 2\nr NA 4\n")
    got = csv_table(spark, f"file://{tmp_path}/x.txt", "name string, a double, b int", skip=2, sep=" ").count()
    assert got == 2


def test_npy_round_trip(spark, tmp_path):
    want = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    np.save(tmp_path / "x_0.npy", want)
    row = npy_table(spark, f"file://{tmp_path}").first()
    assert row["shape"] == [2, 3, 4] and np.array_equal(np.array(row["data"]).reshape(row["shape"]), want)


def test_model_and_stream(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.timestamp_seconds(F.col("id") * 600)).alias("ts"))
    model = Ellipse(["a", "b"]).fit(rows)
    save_model(model, spark, f"file://{tmp_path}/model")
    assert load_model(spark, f"file://{tmp_path}/model")["alpha"] == model.alpha
    write_dataset(rows, f"file://{tmp_path}/in")
    stream = model.score(stream_table(spark, f"file://{tmp_path}/in", rows.schema))
    out = run_to_memory(outlier_rates(stream, "ts"), "rates", f"file://{tmp_path}/state", "complete")
    assert out.agg(F.sum("n")).first()[0] == 400
    assert out.agg(F.sum("inliers")).first()[0] == model.score(rows).where("inlier").count()
