"""Paginated registries, from recorded pages.

Pages are JSON files of a folder on any storage that Spark reads: `first.json`,
then `<cursor>.json` for each next cursor. Reading stops at an empty page, a
page without cursor, or after max_pages. A missing or broken page ends the read
with what there is, or, with failfast, fails it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "io.modelcontextprotocol.registry/official"


def read_registry(spark: SparkSession, path: str, failfast: bool = False, max_pages: int | None = None) -> DataFrame:
    """Entries flattened: the server's fields as they are, with _status, _isLatest and _publishedAt from the nested metadata."""
    return flatten(read_pages(spark, path, failfast, max_pages))


def read_pages(spark: SparkSession, path: str, failfast: bool = False, max_pages: int | None = None) -> DataFrame:
    """(page, entry) of the pages that cursors lead to. Pages are parsed where they are read; only their cursors come to the driver, a short row for each."""
    files = spark.read.option("wholetext", True).text(path, pathGlobFilter="*.json").select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("cursor"), F.try_parse_json("value").alias("body"))
    entries = F.coalesce(F.try_variant_get("body", "$.servers", "array<variant>"), F.array().cast("array<variant>"))
    held = files.select("cursor", F.coalesce(F.schema_of_variant("body").startswith("OBJECT<"), F.lit(False)).alias("ok"), entries.alias("entries"), F.try_variant_get("body", "$.metadata.nextCursor", "string").alias("next"))
    links = {r["cursor"]: r for r in held.select("cursor", "ok", F.size("entries").alias("n"), "next").toLocalIterator()}
    order, cursor = [], "first"
    while cursor and (max_pages is None or len(order) < max_pages):
        page = links.pop(cursor, None)
        if page is None or not page["ok"]:
            if failfast:
                raise ValueError(f"page {cursor!r} is missing or broken")
            break
        if not page["n"]:
            break
        order.append((cursor, len(order)))
        cursor = page["next"]
    places = spark.createDataFrame(order, "cursor string, page int")
    return held.join(places, "cursor").select("page", F.posexplode("entries").alias("at", "e")).orderBy("page", "at").select("page", F.to_json("e").alias("entry"))


def flatten(pages: DataFrame) -> DataFrame:
    rec = F.parse_json("entry")

    def get(path: str, kind: str):
        return F.try_variant_get(rec, path, kind)

    meta = f'$["_meta"]["{META}"]'
    return pages.select(
        get("$.server.name", "string").alias("name"),
        get("$.server.description", "string").alias("description"),
        get("$.server.version", "string").alias("version"),
        get("$.server.remotes", "array<struct<type: string, url: string>>").alias("remotes"),
        get("$.server.packages", "array<struct<registryType: string, registry_name: string, identifier: string, name: string>>").alias("packages"),
        F.try_variant_get(rec, "$.server.repository", "variant").alias("repository"),
        get("$.server.websiteUrl", "string").alias("websiteUrl"),
        get(f"{meta}.status", "string").alias("_status"),
        F.coalesce(get(f"{meta}.isLatest", "boolean"), F.lit(False)).alias("_isLatest"),
        get(f"{meta}.publishedAt", "string").alias("_publishedAt"),
    )


def transports(latest: DataFrame) -> DataFrame:
    """(name, transport) of every kind of remote and package that a server declares, each once; servers without either are `website` or `nothing`."""
    remote = F.transform(F.coalesce("remotes", F.array()), lambda r: F.concat(F.lit("remote "), F.coalesce(r["type"], F.lit(""))))
    package = F.transform(F.coalesce("packages", F.array()), lambda p: F.concat(F.lit("package "), F.lower(F.coalesce(p["registryType"], p["registry_name"], F.lit("")))))
    kinds = F.array_distinct(F.concat(remote, package))
    none = F.array(F.when(F.coalesce("websiteUrl", F.lit("")) != "", F.lit("website")).otherwise(F.lit("nothing")))
    return latest.select("name", F.explode(F.when(F.size(kinds) > 0, kinds).otherwise(none)).alias("transport"))


def remotes(registry: DataFrame) -> DataFrame:
    """(name, type, url) of the remotes of active servers."""
    each = registry.where("_status = 'active'").select("name", F.explode("remotes").alias("r")).select("name", "r.type", "r.url")
    return each.where("coalesce(url, '') <> ''")


def packages(registry: DataFrame) -> DataFrame:
    """Distinct (registry, identifier), the identifier or else the name."""
    each = registry.select(F.explode("packages").alias("p"))
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    rows = each.select(pick("p.registryType", "p.registry_name").alias("registry"), pick("p.identifier", "p.name").alias("identifier"))
    return rows.where("registry is not null and identifier is not null").distinct()


# Fields of a crawled model that are kept as they are, and its counters.
KEPT = ("id", "name", "type", "nsfw", "nsfwLevel", "poi", "minor", "sfwOnly", "allowNoCredit", "allowCommercialUse", "allowDerivatives", "allowDifferentLicense", "availability", "supportsGeneration")
COUNTERS = ("downloadCount", "thumbsUpCount", "thumbsDownCount", "commentCount")


def slim_models(items: DataFrame) -> DataFrame:
    """Crawled models (variant column rec) projected to what the census needs; firstPublished is the least of the versions' creation or else publication times."""

    def get(path: str, kind: str):
        return F.try_variant_get("rec", path, kind)

    versions = get("$.modelVersions", "array<struct<createdAt: string, publishedAt: string>>")
    times = F.filter(F.transform(versions, lambda v: F.coalesce(F.nullif(v["createdAt"], F.lit("")), F.nullif(v["publishedAt"], F.lit("")))), lambda t: t.isNotNull())
    return items.select(
        *(get(f"$.{k}", "string").alias(k) for k in KEPT),
        get("$.creator.username", "string").alias("creator"),
        *(F.coalesce(get(f"$.{k}", "array<string>"), F.array().cast("array<string>")).alias(k) for k in ("tags", "baseModels")),
        *(get(f"$.stats.{k}", "long").alias(k) for k in COUNTERS),
        F.coalesce(F.size(versions), F.lit(0)).alias("nversions"),
        F.array_min(times).alias("firstPublished"),
    )
