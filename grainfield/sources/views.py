"""Relational tables seen as coded samples: `frame, plane, y, x, code`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coded(value: Column) -> Column:
    return F.round(value).cast("int")


def event_raster(spark: SparkSession, sf_dir: str, frame: str | None = None, width: int = 100) -> DataFrame:
    """`events` as one raster, or with the column `frame` as the frame of each sample."""
    e = read(spark, sf_dir, "events")
    return e.select(
        (F.col(frame) if frame else F.lit("events")).alias("frame"), F.lit("mono").alias("plane"),
        F.expr(f"event_id div {width}").cast("int").alias("y"), (F.col("event_id") % width).cast("int").alias("x"), coded(F.col("value") * 100).alias("code"),
    )


def embedding_tiles(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """`embeddings` as square tiles: frame and ordinal are the id, geometry is the label."""
    e = read(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).select(
        F.col("vec_id").alias("frame"), F.col("label").alias("geometry"), F.expr(f"i div {side}").cast("int").alias("y"), (F.col("i") % side).alias("x"),
        coded((F.col("v").cast("double") + 1) / 2 * 65535).alias("code"),
    )


def price_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` prices as codes by return flag (a group, without places)."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("frame"), F.lit("mono").alias("plane"), coded(F.col("l_extendedprice") / 2).alias("code"))


def order_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("frame"), F.lit("mono").alias("plane"), coded(F.col("o_totalprice") / 8).alias("code"))


def dust_scenes(spark: SparkSession, frames: int = 4, height: int = 240, width: int = 320) -> DataFrame:
    """Planted dust: smooth scenes that differ by frame, a dark spot that moves with the scene, and two dips that stay."""
    at = spark.range(frames * height * width).select(
        F.expr(f"id div {height * width}").alias("k"), F.expr(f"id % {height * width} div {width}").cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x")
    )
    k, y, x = (F.col(c).cast("double") for c in ("k", "y", "x"))
    log = -1.2 + (0.1 + 0.05 * k) * x / width - (0.3 - 0.1 * k) * y / height + 0.2 * F.sin(k + x / 40) * F.cos(k + y / 50)
    spot = lambda px, py, sigma, depth: depth * F.exp(-((x - px) * (x - px) + (y - py) * (y - py)) / (2 * sigma * sigma))
    log = log - spot(40 + 60 * k, 60, 4.0, 0.25) - spot(180.5, 150.5, 3.0, 0.3) - spot(260.5, 90.5, 3.0, 0.3)
    code = F.least(F.greatest(F.round(F.exp(log) * 60000), F.lit(0)), F.lit(65535)).cast("int")
    return at.select(F.col("k").alias("frame"), F.lit("mono").alias("plane"), "y", "x", code.alias("code"))
