"""Retained files and bundles: inventories, manifests, completeness, state, commit gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw records every request keeps, and the three files a repetition keeps once.
RAW_REQUEST_FIELDS = (
    "http_exchange", "request_body", "request_headers", "response_headers", "raw_response_body",
    "server_logs",
)
REPETITION_FILES = (
    "raw/cancellation/client-wire.json",
    "raw/prometheus/measured-window-baseline.json",
    "raw/prometheus/measured-window-final.json",
)


def read_files(spark: SparkSession, folder: str, bundle_id: str) -> DataFrame:
    """Every file below ``folder`` with its content; paths are relative to the folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.substring_index("path", f"{folder.rstrip('/')}/", -1)
    return read.select(
        F.lit(bundle_id).alias("bundle_id"), relative.alias("path"), "content",
        F.col("modificationTime").alias("modified_at"),
    )


def file_inventory(files: DataFrame) -> DataFrame:
    """Size and SHA-256 of each file's bytes."""
    return files.select(
        "bundle_id", "path",
        F.octet_length("content").cast("long").alias("size"),
        F.sha2("content", 256).alias("sha256"),
    )


def bundle_audit(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Listed against found: missing, unexpected, or different in size or hash."""
    m = manifest.select("bundle_id", "path", F.struct("size", "sha256").alias("m"))
    a = actual.select("bundle_id", "path", F.struct("size", "sha256").alias("a"))
    status = (
        F.when(F.col("a").isNull(), "MISSING")
        .when(F.col("m").isNull(), "UNEXPECTED")
        .when(F.col("m.size") != F.col("a.size"), "SIZE_DIFFERS")
        .when(F.col("m.sha256") != F.col("a.sha256"), "HASH_DIFFERS")
    )
    return m.join(a, ["bundle_id", "path"], "full_outer").select(
        "bundle_id", "path", status.alias("status")
    ).where("status IS NOT NULL")


def manifest_not_last(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Bundles with a file newer than their manifest (``manifest_at``)."""
    newest = files.groupBy("bundle_id").agg(F.max("modified_at").alias("newest"))
    return manifests.join(newest, "bundle_id").where("newest > manifest_at").select("bundle_id")


def bundle_completeness(
    files: DataFrame, fields: Sequence[str] = RAW_REQUEST_FIELDS, requests: int = 16
) -> DataFrame:
    """Per bundle: requests with exactly the raw kinds, odd paths, and the files kept once.

    The kinds of a request are folded to one bit each, so no group is gathered.
    """
    parts = F.split("path", "/")
    raw = files.where(F.startswith("path", F.lit("raw/requests/")))
    shaped = raw.select(
        "bundle_id",
        F.get(parts, F.lit(2)).alias("request"),
        F.regexp_replace(F.get(parts, F.lit(3)), "\\.json$", "").alias("kind"),
        ((F.size(parts) == 4) & F.endswith("path", F.lit(".json"))).alias("ok"),
    )
    per_request = shaped.groupBy("bundle_id", "request").agg(
        F.count_if(~F.col("ok")).alias("odd"),
        *[F.count_if(F.col("ok") & (F.col("kind") == k)).alias(f"n_{i}") for i, k in enumerate(fields)],
        F.count_if(F.col("ok") & ~F.col("kind").isin(*fields)).alias("foreign"),
    )
    whole = (F.col("odd") == 0) & (F.col("foreign") == 0)
    for i in range(len(fields)):
        whole = whole & (F.col(f"n_{i}") == 1)
    requests_of = per_request.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(whole).alias("complete_requests"),
        F.sum("odd").alias("odd_paths"),
    )
    once = files.groupBy("bundle_id").agg(
        *[F.count_if(F.col("path") == p).alias(f"f_{i}") for i, p in enumerate(REPETITION_FILES)]
    )
    have = F.lit(True)
    for i in range(len(REPETITION_FILES)):
        have = have & (F.col(f"f_{i}") == 1)
    return requests_of.join(once, "bundle_id").select(
        "bundle_id", "requests", "complete_requests", "odd_paths", have.alias("has_repetition_files"),
        ((F.col("requests") == requests) & (F.col("complete_requests") == requests)
         & (F.col("odd_paths") == 0) & have).alias("complete"),
    )


def bundle_state(states: DataFrame, manifests: DataFrame) -> DataFrame:
    """A manifest decides; else the last recorded state; else INCOMPLETE."""
    last = states.groupBy("bundle_id").agg(F.max_by("state", "sequence").alias("recorded"))
    m = manifests.groupBy("bundle_id").agg(F.max("manifest_state").alias("manifest_state"))
    return last.join(m, "bundle_id", "full_outer").select(
        "bundle_id", F.coalesce("manifest_state", "recorded", F.lit("INCOMPLETE")).alias("state")
    )


def write_evidence(tables: Mapping[str, DataFrame], manifest: DataFrame, folder: str, commit: str = "0") -> None:
    """Data first, partitioned by run and commit; the manifest rows follow only when all of it is there.

    Partitions are overwritten, so the same commit written again, after a failure or not, leaves the same
    rows. The manifest has one partition for each run and names the commit that counts; what another
    commit of the run has left stays invisible.
    """
    def put(df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    for name, df in tables.items():
        put(df.withColumn("commit_id", F.lit(f"c{commit}")), f"{folder}/{name}", "run_id", "commit_id")
    put(manifest.withColumn("commit_id", F.lit(f"c{commit}")), f"{folder}/manifests", "run_id")


def read_committed(spark: SparkSession, folder: str, name: str, schema, manifest_schema) -> DataFrame:
    """Only runs with a manifest row exist for the reader; a half-written run stays invisible."""
    commit = T.StructField("commit_id", T.StringType())
    data = spark.read.schema(T.StructType([*schema.fields, commit])).parquet(f"{folder}/{name}")
    manifests = spark.read.schema(T.StructType([*manifest_schema.fields, commit])).parquet(f"{folder}/manifests")
    committed = manifests.where("state = 'COMMITTED'").select("run_id", "commit_id").distinct()
    return data.join(committed, ["run_id", "commit_id"], "left_semi").select(*schema.fieldNames())
