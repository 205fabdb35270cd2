"""Repository links in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import REPO, SITE_PAGES, clean_repo


def mentioned(df: DataFrame, text: str) -> DataFrame:
    """A row with slug for each link to a repository; pages of the site and broken names are left out. A cheap test comes before the expression."""
    some = df.where(F.contains(F.lower(text), F.lit("github.com")))
    each = some.withColumn("__link", F.explode(F.regexp_extract_all(text, F.lit(REPO), 0)))
    parts = each.select(*(c for c in df.columns if c != text), F.regexp_extract("__link", REPO, 1).alias("__owner"), clean_repo(F.regexp_extract("__link", REPO, 2)).alias("__repo"))
    kept = parts.where(F.col("__repo").isNotNull() & ~F.lower("__owner").isin(*SITE_PAGES))
    return kept.withColumn("slug", F.concat_ws("/", "__owner", "__repo")).drop("__owner", "__repo")
