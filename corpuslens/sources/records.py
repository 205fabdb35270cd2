"""Record sets: JSON lines with stable numbers, and other files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.text import strip
from corpuslens.session import stage

SPACES = "id string, author string, sdk string, likes string, private string, stage string, hardware string, created_at string, last_modified string"


def _numbered(lines: DataFrame, by: str) -> DataFrame:
    """lines (file, block, seq, value) with the number of each row over all blocks, from 0: counts of blocks, then places inside them."""
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")) - 1
    return lines.withColumn("own", inside).join(first, ["file", "block"]).withColumn(by, F.col("first") + F.col("own")).drop("own", "first")


def load_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(row_idx, value, rec) of well-formed objects, and (line_no) of malformed lines.

    Lines keep their order over files and blocks. Blank lines count as lines
    but are neither records nor malformed. Values that aren't objects, and the
    constants NaN and Infinity, are malformed.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    lines = stage(_numbered(raw, "line_no"), "jsonl")
    parsed = lines.withColumn("rec", F.try_parse_json("value")).where(strip(F.col("value")) != "").withColumn("ok", F.coalesce(F.schema_of_variant("rec").startswith("OBJECT<"), F.lit(False)))
    records = _numbered(parsed.where("ok").select("file", "block", "seq", "value"), "row_idx")
    return records.select("row_idx", "value", F.parse_json("value").alias("rec")), parsed.where("not ok").select((F.col("line_no") + 1).alias("line_no"))


def load_models(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of well-formed lines; all others are skipped without count."""
    rows = spark.read.text(path).where("schema_of_variant(try_parse_json(value)) LIKE 'OBJECT<%'")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def load_spaces(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue snapshot with header, all strings, fields of up to ten million characters."""
    return spark.read.option("header", True).option("multiLine", True).option("maxCharsPerColumn", 10_000_000).option("escape", '"').csv(path, schema=SPACES)


def load_shards(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet shards below a glob, the columns asked for only, unreadable shards skipped."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path).select(*columns)


def load_summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Summaries of finished audits, one file each, in order of their paths."""
    count = "struct<near_duplicate_clusters: long, records_in_clusters: long, fully_identical_clusters: long, records_fully_identical: long, shared_stem_variant_clusters: long>"
    schema = f"name string, records long, schema_issues long, degenerate_records long, similarity_method string, similarity_threshold double, rates_pct struct<exact_duplicate_text: double, records_in_clusters: double, fully_identical: double>, duplicates {count}, distributions struct<distinct_groups: long, top_group_share: double>"
    return spark.read.option("multiLine", True).schema(schema).json(paths).withColumn("path", F.input_file_name())


def load_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A census history, or no rows where there is none yet."""
    try:
        return spark.read.option("header", True).csv(path, schema=schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T._parse_datatype_string(schema))


def guess_field(columns: list[str], candidates: list[str], exclude: tuple[str, ...] = ()) -> str | None:
    """The first candidate that is a column and isn't taken."""
    return next((c for c in candidates if c in columns and c not in exclude), None)
