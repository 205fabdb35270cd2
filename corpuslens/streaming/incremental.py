"""Exact duplicates of a growing record set, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslens.functions.text import normalize_text


def digests(stream: DataFrame, text: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """(digest, records) of normalized texts so far. With a time column, counts are by day and those older than `late` leave the state."""
    rows = stream.select(F.sha2(normalize_text(F.col(text)), 256).alias("digest"), *([F.col(time).alias("ts")] if time else []), (normalize_text(F.col(text)) == "").alias("blank")).where("not blank")
    if time:
        return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "digest").agg(F.count("*").alias("records"))
    return rows.groupBy("digest").agg(F.count("*").alias("records"))


def first_seen(stream: DataFrame, text: str, time: str, late: str = "1 day") -> DataFrame:
    """Records whose normalized text has not come before within the watermark."""
    return stream.withColumn("digest", F.sha2(normalize_text(F.col(text)), 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["digest"])


def write_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the changed counts of each batch as Parquet below path, by batch."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
