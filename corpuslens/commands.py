"""Commands of the censuses: recorded pages, probes and answers in, figures and files out."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.plans import audit, census
from corpuslens.sources import records, registry, sinks

#: Options of each command; those with a default may be left out.
OPTIONS: dict[str, dict[str, str | None]] = {
    "fetch-registry": {"pages": None, "out": None, "max-pages": "0"},
    "clone-detect": {"data": None, "out": "-"},
    "clone-experiment": {"data": None, "out": "-"},
    "published-tables": {"data": None, "out": "-"},
    "models-census": {"data": None, "out": "-"},
    "registry-census": {"pages": None, "date": None, "history": None, "out": "-"},
    "remote-health": {"pages": None, "probes": None, "out": "-"},
    "dead-packages": {"pages": None, "checks": None, "out": "-"},
    "link-extract": {"data": None, "out": None},
    "link-resolve": {"slugs": None, "codes": None, "results": None, "retry": "no"},
    "link-analyze": {"sample": None, "results": None, "out": "-"},
    "traction": {"figures": None, "history": None, "out": "-"},
}


def add_to(commands: argparse._SubParsersAction) -> None:
    for name, options in OPTIONS.items():
        sub = commands.add_parser(name)
        for option, default in options.items():
            sub.add_argument(f"--{option}", default=default, required=default is None)


def put(value: object, out: str) -> None:
    if out == "-":
        print(json.dumps(value, indent=2, ensure_ascii=False, default=str))
    else:
        audit.write_json(value, out)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    name = args.command
    if name in ("fetch-registry", "registry-census", "remote-health", "dead-packages"):
        versions = registry.read_registry(spark, args.pages, max_pages=int(getattr(args, "max_pages", 0)) or None)
    if name == "fetch-registry":
        sinks.write_registry(versions, args.out)
    elif name in ("clone-detect", "clone-experiment", "published-tables"):
        plan = {"clone-detect": census.clone_detect, "clone-experiment": census.clone_experiment, "published-tables": census.published_tables}[name]
        put(plan(records.load_spaces(spark, args.data)), args.out)
    elif name == "models-census":
        models = records.load_models(spark, args.data, "dl30 double, likes double, hascard boolean, lic_c string")
        put(census.models_census(models.withColumn("id", F.monotonically_increasing_id())), args.out)
    elif name == "registry-census":
        figures = census.registry_census(versions, args.date)
        history = sinks.write_history(spark, args.history, figures, census.CENSUS_HISTORY)
        numbers = T._parse_datatype_string(census.CENSUS_HISTORY).names[1:]
        put(figures | {"changes": census.changes(history, numbers)}, args.out)
    elif name == "remote-health":
        probes = spark.read.schema("url string, host_ok boolean, dns_ok boolean, code int, error string").json(args.probes)
        put(census.remote_health(registry.remotes(versions), probes), args.out)
    elif name == "dead-packages":
        checks = spark.read.schema("registry string, identifier string, code int").json(args.checks)
        put(census.dead_packages(registry.packages(versions), checks), args.out)
    elif name == "link-extract":
        papers = records.load_shards(spark, args.data, ["id", "categories", "abstract", "comments", "versions"])
        sinks.write_links(*census.link_extract(papers), args.out)
    elif name == "link-resolve":
        done = sinks.load_results(spark, args.results)
        wanted = census.to_resolve(spark.read.schema("slug string").json(args.slugs), done, args.retry == "yes")
        codes = spark.read.schema("slug string, found boolean, error string, batch_failed boolean, archived boolean").json(args.codes).join(wanted, "slug", "left_semi")
        status = census.resolved(codes).join(codes.select("slug", "archived", F.col("error").alias("reason")), "slug")
        sinks.append_results(status, args.results)
    elif name == "link-analyze":
        sample = spark.read.schema("slug string, year int").parquet(args.sample)
        put(census.link_analyze(sample, sinks.load_results(spark, args.results)), args.out)
    elif name == "traction":
        with open(args.figures, encoding="utf-8") as f:
            figures = json.load(f)
        history = sinks.write_history(spark, args.history, figures, census.TRACTION_HISTORY)
        fields = T._parse_datatype_string(census.TRACTION_HISTORY)
        put(census.changes(history, [x.name for x in fields if isinstance(x.dataType, T.LongType)]), args.out)
