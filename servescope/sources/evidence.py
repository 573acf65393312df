"""JSON-lines evidence with closed, explicit schemas; bad lines are rows with a violation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servescope.sources.lines import read_lines, unterminated_files  # noqa: F401


def read_run_evidence(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, required: tuple[str, ...] = ()
) -> DataFrame:
    """Each line against the closed schema.

    Columns of the schema plus ``source_file``, ``line_ordinal``, ``terminated`` and ``violation``:
    BLANK_LINE, MALFORMED_JSON, UNKNOWN_FIELD (at any depth), MISSING_FIELD, or null.
    """
    lines = read_lines(spark, paths).select("value", "source_file", "line_ordinal", "terminated")
    return parse_lines(lines, schema, required)


def parse_lines(lines: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    closed = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = lines.withColumn(
        "__v", F.from_json("value", closed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ).withColumn("__keys", F.json_object_keys("value"))
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(f"__v.{name}").isNull()
    violation = (
        F.when(F.trim("value") == "", "BLANK_LINE")
        .when(F.col("__keys").isNull() | F.col("__v._corrupt").isNotNull(), "MALFORMED_JSON")
        .when(unknown_fields(F.col("value"), schema), "UNKNOWN_FIELD")
        .when(missing, "MISSING_FIELD")
    )
    carried = [c for c in lines.columns if c != "value"]
    return read.select(*[F.col(f"__v.{n}").alias(n) for n in schema.fieldNames()], *carried,
                       violation.alias("violation"))


def unknown_fields(text: Column, schema: T.StructType) -> Column:
    """A field that the schema does not name, in the object or in one below it."""
    unknown = F.size(F.array_except(F.json_object_keys(text), F.array(*[F.lit(n) for n in schema.fieldNames()]))) > 0
    for field in schema.fields:
        below = F.get_json_object(text, f"$['{field.name}']")
        if isinstance(field.dataType, T.StructType):
            unknown = unknown | F.coalesce(unknown_fields(below, field.dataType), F.lit(False))
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            unknown = unknown | F.coalesce(_unknown_in_items(below, field.dataType.elementType), F.lit(False))
    return unknown


def _unknown_in_items(text: Column, schema: T.StructType) -> Column:
    return F.exists(F.from_json(text, "array<string>"), lambda x: F.coalesce(unknown_fields(x, schema), F.lit(False)))


def read_versioned(documents: DataFrame, schemas: Mapping[str, T.StructType], text: str = "content") -> DataFrame:
    """Whole documents, each read once with the schema its ``schema_version`` names.

    Fields of the same name have the same type in all versions. ``violation``: MALFORMED_JSON,
    REPEATED_FIELD (a name twice in one object, at any depth), UNKNOWN_VERSION, UNKNOWN_FIELD (at any
    depth), WRONG_TYPE, or null; a document with one has no fields.
    """
    carried = [c for c in documents.columns if c != text]
    version = F.get_json_object(text, "$.schema_version")
    read, unknown, corrupt = {}, F.lit(False), F.lit(False)
    for name, schema in schemas.items():
        named = T.StructType([f for f in schema.fields if f.name != "schema_version"])
        closed = T.StructType([*named.fields, T.StructField("schema_version", T.StringType()), T.StructField("_corrupt", T.StringType())])
        mine = F.when(version == name, F.from_json(text, closed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        read[name] = (mine, named)
        full = T.StructType([*named.fields, T.StructField("schema_version", T.StringType())])
        unknown = F.when(version == name, unknown_fields(F.col(text), full)).otherwise(unknown)
    parsed = documents.select(
        *carried, version.alias("schema_version"), F.struct(*[m.alias(f"v{i}") for i, (m, _) in enumerate(read.values())]).alias("__read"),
        F.get_json_object(text, "$").isNull().alias("__broken"), F.try_parse_json(text).isNull().alias("__repeats"), unknown.alias("__unknown"))
    for i in range(len(read)):
        corrupt = corrupt | F.coalesce(F.col(f"__read.v{i}._corrupt").isNotNull(), F.lit(False))
    violation = (
        F.when(F.col("__broken"), "MALFORMED_JSON")
        .when(F.col("__repeats"), "REPEATED_FIELD")
        .when(~F.coalesce(F.col("schema_version").isin(*schemas), F.lit(False)), "UNKNOWN_VERSION")
        .when(F.col("__unknown"), "UNKNOWN_FIELD")
        .when(corrupt, "WRONG_TYPE")
    )
    fields: dict[str, list[Column]] = {}
    for i, (_, schema) in enumerate(read.values()):
        for name in schema.fieldNames():
            fields.setdefault(name, []).append(F.col(f"__read.v{i}.{name}"))
    told = parsed.withColumn("violation", violation)
    return told.select(
        *carried, "schema_version", *[F.when(F.col("violation").isNull(), F.coalesce(*c)).alias(n) for n, c in fields.items()], "violation")
