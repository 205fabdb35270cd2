"""Exact duplicates, degenerate records and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import strip


def exact_groups(df: DataFrame, key: Column, row: str) -> DataFrame:
    """(first_row, records) of each key that isn't empty and that two rows or more have. Members are not gathered: a join on the key gives them."""
    return df.select(key.alias("key"), F.col(row).alias("row")).where("key <> ''").groupBy("key").agg(F.min("row").alias("first_row"), F.count("*").alias("records")).where("records > 1").select("first_row", "records")


def duplicate_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("dup_groups"), F.coalesce(F.sum("records"), F.lit(0)).alias("dup_records"))


def degenerate(df: DataFrame, row: str, text: str | None = None, answer: str | None = None, group: str | None = None) -> DataFrame:
    """(row, reasons) of rows whose configured roles are blank."""
    roles = [(c, f"empty_{name}") for name, c in (("text", text), ("answer", answer), ("group", group)) if c]
    reasons = F.array_compact(F.array(*(F.when(strip(F.col(c).cast("string")) == "", why) for c, why in roles)))
    return df.select(F.col(row), reasons.alias("reasons")).where("size(reasons) > 0")


def distribution(df: DataFrame, value: str, row: str) -> DataFrame:
    """(value, records, first_row) by count; ties keep the order in which values first appear. Null is empty, and empty is a value."""
    return df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("records"), F.min(row).alias("first_row"))


def distribution_summary(dist: DataFrame) -> DataFrame:
    """Distinct values, mean records of a value and the largest value's share, unrounded."""
    total = F.sum("records")
    return dist.agg(F.count("*").alias("distinct_values"), (total / F.count("*")).alias("mean_records"), (F.max("records") / total).alias("top_share"))


def ordered(dist: DataFrame, k: int | None = None) -> DataFrame:
    rows = dist.orderBy(F.desc("records"), "first_row")
    return rows.limit(k) if k else rows
