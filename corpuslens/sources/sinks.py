"""Outputs that are kept over runs: on any storage that Spark writes, without a step that can lose what was there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.operators.census import upserted
from corpuslens.plans.census import cohorts_of_links
from corpuslens.session import stage
from corpuslens.sources.records import load_history

RESULTS = "slug string, status string, archived boolean, reason string, line_no long"


def write_registry(versions: DataFrame, path: str) -> None:
    """All versions below path/versions and the latest ones below path/latest, as JSON lines."""
    for name, rows in (("versions", versions), ("latest", versions.where("_isLatest"))):
        text = rows.withColumn("repository", F.to_json("repository"))
        text.write.mode("overwrite").json(f"{path}/{name}")


def append_results(results: DataFrame, path: str) -> None:
    """Adds results (slug, status, archived, reason) behind those of earlier runs, as JSON lines; a failed run adds nothing."""
    spark = results.sparkSession
    last = load_results(spark, path).agg(F.max("line_no")).first()[0]
    first = 0 if last is None else last + 1
    rows = results.select("slug", "status", "archived", "reason", (F.monotonically_increasing_id() + first).alias("line_no"))
    rows.write.mode("append").json(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of all runs in their order (line_no), or none where there are none yet."""
    try:
        return spark.read.schema(RESULTS).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T._parse_datatype_string(RESULTS))


def write_history(spark: SparkSession, path: str, row: dict, schema: str, date: str = "date") -> DataFrame:
    """Puts a day's figures into a history in place of that day's earlier ones, and returns it.

    The new history is written beside the old one first; only then the old one
    is replaced, from that copy.
    """
    names = T._parse_datatype_string(schema).names
    new = spark.createDataFrame([tuple(row.get(k) for k in names)], schema)
    whole = stage(upserted(load_history(spark, path, schema), new, date), "history")
    whole.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return whole


def write_links(mentions: DataFrame, repositories: DataFrame, path: str) -> None:
    """Mentions and repositories as Parquet, and the number of repositories by year of their first mention as CSV."""
    mentions.write.mode("overwrite").parquet(f"{path}/mentions")
    held = stage(repositories, "links")
    held.write.mode("overwrite").parquet(f"{path}/repositories")
    cohorts_of_links(held).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/cohorts")
