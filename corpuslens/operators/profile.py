"""Schema profile of JSON records: types, presence, deviations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fields(lines: DataFrame, row: str = "row_idx", line: str = "value") -> DataFrame:
    """(row, field, at, py_type) of every field of every JSON object; at is its place in the source.

    Types carry Python's names. Integers and floats differ by their token, as
    1.0 and 1 are one number to the parser. Of a repeated key the last value
    counts.
    """
    parsed = lines.select(F.col(row).alias("row"), F.col(line).alias("line"), F.try_parse_json(F.col(line)).alias("rec"))
    each = lines.sparkSession.sql("SELECT row, line, v.key AS field, schema_of_variant(v.value) AS kind FROM {t}, LATERAL variant_explode(rec) v WHERE schema_of_variant(rec) LIKE 'OBJECT<%'", t=parsed)
    raw, kind = F.expr("get_json_object(line, concat(\"$['\", field, \"']\"))"), F.col("kind")
    name = (
        F.when(kind == "VOID", "NoneType").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool")
        .when(kind.startswith("ARRAY<"), "list").when(kind.startswith("OBJECT<"), "dict")
        .when((kind == "DOUBLE") | raw.rlike("[.eE]"), "float").otherwise("int")
    )
    return each.select("row", "field", F.array_position(F.json_object_keys("line"), F.col("field")).alias("at"), name.alias("py_type"))


def type_counts(fields: DataFrame) -> DataFrame:
    """(field, py_type, records, first_row, first_at)."""
    return fields.groupBy("field", "py_type").agg(F.count("*").alias("records"), F.min(F.struct("row", "at")).alias("first")).select("field", "py_type", "records", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"))


def schema(counts: DataFrame) -> DataFrame:
    """(field, majority, present, first_row, first_at): the type most records have, ties to the one seen first."""
    rank = F.struct("records", -F.col("first_row"), -F.col("first_at"))
    return counts.groupBy("field").agg(F.max_by("py_type", rank).alias("majority"), F.sum("records").alias("present"), F.min(F.struct("first_row", "first_at")).alias("f")).select("field", "majority", "present", "f.first_row", "f.first_at")


def issue_counts(counts: DataFrame, schema: DataFrame, total: int) -> DataFrame:
    """(field, missing, inconsistent) without making a row for each issue."""
    deviating = counts.join(schema.select("field", "majority"), "field").groupBy("field").agg(F.coalesce(F.sum(F.when(F.col("py_type") != F.col("majority"), F.col("records"))), F.lit(0)).alias("inconsistent"))
    return schema.join(deviating, "field").select("field", (F.lit(total) - F.col("present")).alias("missing"), "inconsistent")


def issues(rows: DataFrame, fields: DataFrame, schema: DataFrame, total: int) -> DataFrame:
    """(row, field, issue, expected, got) of each record of rows (row, line) that lacks a field or has another type than most. schema has a row for each field only."""
    gaps = F.array(*(F.lit(r["field"]) for r in schema.where(F.col("present") < total).select("field").collect())).cast("array<string>")
    lacking = F.array_except(gaps, F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")))
    missing = rows.select("row", F.explode(lacking).alias("field")).select("row", "field", F.lit("missing_field").alias("issue"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("got"))
    other = fields.join(schema.select("field", "majority"), "field").where("py_type <> majority").select("row", "field", F.lit("inconsistent_type").alias("issue"), F.col("majority").alias("expected"), F.col("py_type").alias("got"))
    return missing.unionByName(other)
