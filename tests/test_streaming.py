"""Histograms and windows over files that arrive."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from grainfield.operators import histogram
from grainfield.streaming import histograms

SCHEMA = "frame string, plane string, code int, at timestamp"


def arrive(spark, folder, minutes):
    base = datetime(2024, 1, 1)
    rows = [("f", "mono", m % 7, base + timedelta(minutes=m)) for m in minutes]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_counts_of_files_that_arrive(spark, tmp_path):
    files, counts, checkpoint = (str(tmp_path / n) for n in ("in", "counts", "checkpoint"))
    for minutes in (range(0, 50), range(20, 90)):
        arrive(spark, files, minutes)
        histograms.ingest(spark.readStream.schema(SCHEMA).parquet(files), lambda b: b, counts, checkpoint).awaitTermination(60)
    got = {(r.frame, r.plane, r.code): r.n for r in histograms.merged(spark, counts).collect()}
    want = {(r.frame, r.plane, r.code): r.n for r in histogram.histogram(spark.read.parquet(files)).collect()}
    assert got == want and sum(got.values()) == 120


def test_windows_and_late_rows(spark, tmp_path):
    files = str(tmp_path / "in")
    query = None
    # Rows of the first hour come after the watermark has passed its end: they are too late.
    for minutes in (range(0, 60), range(300, 330), range(0, 10)):
        arrive(spark, files, minutes)
        stream = histograms.windowed(spark.readStream.schema(SCHEMA).parquet(files), "at", "code")
        query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.start, r.low, r.high, r.n) for r in out] == [(datetime(2024, 1, 1), 0, 6, 60)]
    table = histograms.windowed(spark.read.parquet(files), "at", "code").agg(F.sum("n").alias("n")).first()
    assert table.n == 100
