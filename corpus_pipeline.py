"""A training corpus from `documents`: five stages, each written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from grainfield.llm.common import cut, quoted, spread, table


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """`df` with the columns of `docs`."""
    return df.select(*[F.col(quoted(c)) for c in docs.columns])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id isn't in `ids`; null ids stay."""
    return _like(docs.join(spread(ids.select(F.col("doc_id"))), "doc_id", "left_anti"), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic."""
    return _like(toxicity.toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line only in the smallest document that holds it."""
    got = line_dedup.kept_lines(docs)
    return _like(got.withColumn("n_chars", F.length("text").cast("long")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more."""
    got = near_dup.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    return _without(docs, got.where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth of their words in benchmark windows."""
    got = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, got.where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of languages and topics, and source shares that are nearer to each other."""
    got = mixing.mixed(mixing.with_topic(docs), ["source", "lang", "topic"], "tokens", mixing.targets(spark), rate=mixing.RATE)
    return got.where("selected").drop("selected")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Models, similarity groups and raking are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
