"""The corpus pipeline: quality, near-duplicates, leaks, secrets, mixing; each stage reads what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servescope.llm import decontaminate, mixing, near_dup, quality_rules, secrets
from servescope.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _row(docs: DataFrame) -> Column:
    """All columns in one struct, so that none of them can clash with a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"row.`{c}`") for c in docs.columns]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior keep."""
    return quality_rules.good_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group; of several rows of that id, the
    first by text. Rows with a null id stay."""
    dropped = cut(near_dup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("id")).distinct())
    rows = docs.select(F.col("doc_id").alias("id"), _row(docs))
    ids = docs.select(F.col("doc_id").alias("id")).where("id IS NOT NULL")
    repeated = cut(ids.groupBy("id").count().where("count > 1").select("id").join(dropped, "id", "left_anti"))
    # only the texts of repeated ids are dealt by id; the lists of ids are stored, so their size is known
    alone = rows.join(dropped.union(repeated), "id", "left_anti")
    several = rows.join(repeated, "id", "left_semi")
    first = several.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("row.text"))).where("n = 1")
    return alone.select("row").union(first.select("row")).select(*_columns(docs))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, told apart by id and text, so a null id is no shelter."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), _row(docs))
    leaked = decontaminate.contained_items(keyed.selectExpr("key AS doc_id", "row.text AS text"), items).selectExpr("doc_id AS key").distinct()
    return keyed.join(leaked, "key", "left_anti").select(*_columns(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by ``[SECRET]``."""
    return secrets.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_quality),
    ("near duplicates", one_of_each_group),
    ("benchmark decontamination", without_leaks),
    ("secret scans", without_secrets),
    ("source mixing", mixed),
]

#: The label model of the first stage is fitted by iteration and the last one's schedule depends on a
#: hash, which SQL does not express; tests/llm run each stage on edge cases and compare its operators.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
