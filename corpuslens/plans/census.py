"""Censuses of catalogues: one dictionary of figures each, from a row or few of each plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import census as C
from corpuslens.operators.ordering import keep_last
from corpuslens.plans.links import mentioned
from corpuslens.session import stage
from corpuslens.sources.registry import transports

#: Stages that count as broken; asleep and paused ones don't.
BROKEN = ("RUNTIME_ERROR", "BUILD_ERROR", "CONFIG_ERROR", "NO_APP_FILE")
TEMPLATE = "describe what your server does"


def items_of_spaces(spaces: DataFrame, static: bool = False, sdk_needed: bool = False) -> DataFrame:
    """(id, family, created, modified, broken, sdk, year) of a snapshot; rows without readable dates are dropped."""
    rows = spaces if static else spaces.where("coalesce(sdk, '') <> 'static'")
    rows = rows.where("coalesce(sdk, '') <> ''") if sdk_needed else rows
    dated = rows.withColumns({"created": X.parsed_time(F.col("created_at")), "modified": X.parsed_time(F.col("last_modified"))}).where("created is not null and modified is not null")
    return dated.select("id", F.col("last_modified").alias("family"), "created", "modified", F.coalesce(F.col("stage").isin(*BROKEN), F.lit(False)).alias("broken"), "sdk", F.substring("created_at", 1, 4).cast("int").alias("year"))


def clone_detect(spaces: DataFrame, static: bool = False) -> dict:
    """Rates of broken items, raw and with each copy family as one, the most copied names, and how many rows have no readable dates."""
    items = stage(items_of_spaces(spaces, static), "items")
    asked = spaces if static else spaces.where("coalesce(sdk, '') <> 'static'")
    figures = C.collapsed_rates(items, C.families(items, "family")).first().asDict()
    copies = items.where("modified < created").groupBy(X.repo_name(F.col("id")).alias("name")).agg(F.count("*").alias("n"))
    return figures | {"skipped": asked.count() - figures["items"], "top_names": [(r["name"], r["n"]) for r in copies.orderBy(F.desc("n"), "name").limit(6).collect()]}


def clone_experiment(spaces: DataFrame, years: tuple[int, ...] = (2022, 2023, 2024, 2025, 2026), least: int = 20) -> dict:
    """Age against breakage inside copy families: cohorts, halves with a sign test, and rates at one year."""
    items = stage(items_of_spaces(spaces, sdk_needed=True), "items")
    copies = items.where("modified < created")
    pinned = C.pinned_year_rates(copies.withColumn("year", F.year("created")), "year", least).withColumn("rate", F.col("broken") / F.col("members"))
    rates = pinned.agg(F.count("*").alias("families"), F.min("rate").alias("least"), F.max("rate").alias("most"), F.median("rate").alias("median"), F.count_if(F.col("rate") == 0).alias("none"), F.count_if(F.col("rate") > 0.5).alias("over_half"))
    return {
        "cohorts": [r.asDict() for r in C.cohorts(items, "sdk", "year", list(years)).orderBy("sdk").collect()],  # a row for each sdk
        "sign_test": C.sign_test(C.family_halves(copies, least)).first().asDict(),
        "pinned_year": rates.first().asDict(),
    }


def models_census(models: DataFrame, downloads: str = "dl30", likes: str = "likes", card: str = "hascard", licence: str = "lic_c") -> dict:
    """Flags, licences, and what share the most downloaded hold. models needs a unique id."""
    flags = models.agg(F.count("*").alias("models"), F.count_if(X.absent(F.col(downloads), "number")).alias("no_downloads"), F.count_if(X.absent(F.col(likes), "number")).alias("no_likes"), F.count_if(X.absent(F.col(card), "boolean")).alias("no_card"))
    named = F.when(X.absent(F.col(licence)), "NONE").otherwise(F.col(licence))
    kinds = models.groupBy(named.alias("licence")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "licence").limit(6)
    shares = C.top_shares(models, downloads, "id", [10, 100, 1000, 10000]).orderBy("k").collect()
    middle = C.upper_median(models, downloads, "id").first()
    return flags.first().asDict() | {"licences": {r["licence"]: r["n"] for r in kinds.collect()}, "top_shares": {r["k"]: r["share"] for r in shares}, "upper_median": middle[0] if middle else None}


def registry_census(versions: DataFrame, date: str) -> dict:
    """Figures of a version log (of sources.registry.flatten): the latest version of each server, and what all versions would say."""
    latest = versions.where("_isLatest")
    own = C.publisher_concentration(latest, X.publisher(F.coalesce("name", F.lit("")))).first()
    if not own["names"]:
        raise ValueError("no version is marked as latest")
    bare = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    plain = F.col("repository").isNull() | F.to_json(F.col("repository")).isin("{}", "null", '""', "[]")
    flags = latest.agg(F.count_if(F.col("_status") == "deprecated").alias("deprecated"), F.count_if(bare("remotes") & bare("packages")).alias("no_transport"), F.count_if(plain).alias("no_repository"), F.count_if(F.contains(F.lower("description"), F.lit(TEMPLATE))).alias("template_placeholder")).first()
    most = versions.groupBy("name").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    share = lambda df: round(100 * (C.duplicate_share(df, X.description_key(F.col("description"))).first()["share"] or 0), 2)
    return {
        "date": date, "version_records": versions.count(), "distinct_servers": own["names"], "publishers": own["publishers"], "single_server_publishers": own["singletons"],
        "top10_share_pct": round(100 * own["top_share"], 2), **flags.asDict(), "max_versions_one_server": most, "dup_desc_naive_pct": share(versions), "dup_desc_correct_pct": share(latest),
    }


def remote_health(remotes: DataFrame, probes: DataFrame) -> dict:
    """Classes of recorded probes (url, host_ok, dns_ok, code, error) of declared remotes, and servers none of whose remotes is ok after a hard failure."""
    seen = remotes.join(probes, "url").select("name", X.remote_class(F.col("host_ok"), F.col("dns_ok"), F.col("code"), F.col("error")).alias("class"))
    seen = stage(seen, "probes")
    hard = F.col("class").isin("dns", "http_404", "tls")
    dead = C.dead_only(seen, ["name"], hard, F.col("class") == "ok")
    by = {r["class"]: r["n"] for r in seen.groupBy("class").agg(F.count("*").alias("n")).collect()}
    return {"remotes_probed": sum(by.values()), "by_class": by, "hard_dead": sum(by.get(k, 0) for k in ("dns", "http_404", "tls")), "servers_without_remote": dead.count(), "examples": [r["name"] for r in dead.orderBy("name").limit(25).collect()]}


def dead_packages(packages: DataFrame, checks: DataFrame) -> dict:
    """Missing and unresolved packages of each registry from recorded checks (registry, identifier, code)."""
    rows = packages.join(checks, ["registry", "identifier"], "left").select("registry", X.exists_state(F.col("code")).alias("there"))
    counts = rows.groupBy("registry").agg(F.count("*").alias("checked"), F.count_if(~F.col("there")).alias("missing"), F.count_if(F.col("there").isNull()).alias("unresolved"))
    return {r["registry"]: {"checked": r["checked"], "missing": r["missing"], "unresolved": r["unresolved"], "missing_pct": round(100 * r["missing"] / r["checked"], 2)} for r in counts.collect()}


def link_extract(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, repositories) of papers (id, categories, abstract, comments, versions)."""
    first = F.coalesce(F.get(F.filter("versions", lambda v: v["version"] == "v1"), F.lit(0)), F.get("versions", F.lit(0)))["created"]
    rows = papers.select(
        F.col("id").alias("arxiv_id"),
        F.concat_ws(" ", "abstract", "comments").alias("text"),
        F.coalesce(F.try_to_timestamp(F.regexp_replace(first, "^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss z")), X.parsed_time(first)).alias("date"),
        F.arrays_overlap(F.split(F.coalesce("categories", F.lit("")), r"\s+"), F.array(*map(F.lit, X.ML_CATEGORIES))).alias("is_ml"),
    )
    found = mentioned(rows, "text")
    return found, C.repo_rollup(found)


def cohorts_of_links(repositories: DataFrame) -> DataFrame:
    """(year, repositories, is_ml) by year of the first mention."""
    return repositories.groupBy(F.year("first_date").alias("year")).agg(F.count("*").alias("repositories"), F.count_if("is_ml").alias("is_ml"))


def shares(df: DataFrame, column: str, whole: int | None = None) -> DataFrame:
    """(value, n, share): how often each value of a column stands, and its share of all rows, or of `whole`; a missing value is one of its own."""
    total = df.count() if whole is None else whole
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("share", F.try_divide(F.col("n"), F.lit(total)))


def published_tables(spaces: DataFrame, authors: int = 10) -> dict:
    """The tables of a catalogue census: stages, SDKs with their broken share, the authors with most items, and likes."""
    by = lambda c: [(r["value"], r["n"], r["share"]) for r in shares(spaces, c).orderBy(F.desc("n"), "value").collect()]  # noqa: E731  a row for each stage
    broken = F.coalesce(F.col("stage").isin(*BROKEN), F.lit(False))
    sdk = spaces.groupBy("sdk").agg(F.count("*").alias("n"), F.count_if(broken).alias("broken")).orderBy(F.desc("n"), "sdk")
    top = shares(spaces, "author").orderBy(F.desc("n"), "value").limit(authors)
    likes = spaces.select("id", F.coalesce(F.try_to_number("likes", F.lit("999999999999")).cast("long"), F.lit(0)).alias("likes"))
    none = likes.agg(F.count_if(F.col("likes") == 0).alias("none"), F.count("*").alias("n")).first()
    thousandth = max(none["n"] // 1000, 1)
    share = C.top_shares(likes, "likes", "id", [thousandth], []).first() if none["n"] else None
    return {"stage": by("stage"), "sdk": [(r["sdk"], r["n"], r["broken"]) for r in sdk.collect()], "authors": [(r["value"], r["n"]) for r in top.collect()], "unliked": none["none"], "top_thousandth_of_likes": share["share"] if share else None}


def transport_table(latest: DataFrame) -> DataFrame:
    """(transport, servers, share); a server may declare several, so shares may exceed one together."""
    counts = shares(transports(latest), "transport", latest.count())
    return counts.select(F.col("value").alias("transport"), F.col("n").alias("servers"), "share")


def resolved(codes: DataFrame) -> DataFrame:
    """(slug, status) of recorded answers (slug, found, error, batch_failed): dead only if not found; a failed batch resolves nothing."""
    status = F.when(F.coalesce("batch_failed", F.lit(False)), "unresolved").when(F.col("found"), "alive").when(F.col("error") == "NOT_FOUND", "dead").otherwise("unresolved")
    return codes.select("slug", status.alias("status"))


def to_resolve(slugs: DataFrame, results: DataFrame, retry: bool = False) -> DataFrame:
    """Valid slugs without a result, or, to retry, those whose last one is unresolved."""
    done = keep_last(results, ["slug"], "line_no")
    done = done.where("status <> 'unresolved'") if retry else done
    return slugs.where(X.slug_ok(F.col("slug"))).select("slug").distinct().join(done.select("slug"), "slug", "left_anti")


def link_analyze(sample: DataFrame, results: DataFrame) -> dict:
    """Dead rates with intervals, by cohort, and their rank correlation with age. sample: slug, year; results: slug, status, archived, line_no."""
    last = keep_last(results.select("slug", "status", "archived", "line_no"), ["slug"], "line_no")
    rows = stage(sample.select("slug", "year").join(last, "slug", "left").withColumn("status", F.coalesce("status", F.lit("unresolved"))).withColumn("cohort", F.greatest("year", F.lit(2013))), "linked")
    by = C.dead_rates(rows, "status", [F.col("cohort")]).orderBy("cohort")
    archived = rows.where("status = 'alive'").agg(F.avg(F.col("archived").cast("int")).alias("a")).first()["a"]
    whole = C.dead_rates(rows, "status").first()
    rho = C.spearman(by.where("cohort between 2014 and 2024"), "cohort", "dead_pct").first()["rho"]
    return {"all": whole.asDict() if whole else None, "archived_share": archived, "cohorts": [("<=2013" if r["cohort"] == 2013 else str(r["cohort"]), r.asDict()) for r in by.collect()], "spearman": rho}


#: Columns of the histories.
CENSUS_HISTORY = "date string, version_records long, distinct_servers long, publishers long, single_server_publishers long, top10_share_pct double, deprecated long, no_transport long, no_repository long, template_placeholder long, max_versions_one_server long, dup_desc_naive_pct double, dup_desc_correct_pct double"
TRACTION_HISTORY = "date string, stars long, forks long, watchers long, views_14d long, uniques_14d long, clones_14d long, unique_cloners_14d long, top_referrers string, mcp_issue_comments long, mcp_discussion_comments long, mcp_discussion_upvotes long, hf_issue_comments long"


def changes(history: DataFrame, columns: list[str]) -> list[dict]:
    """The last two days of a history, with what has changed between them; no rows make no entry."""
    last = [r.asDict() for r in history.orderBy(F.desc("date")).limit(2).collect()]
    if not last:
        return []
    now, before = last[0], last[1] if len(last) > 1 else {}
    return [{"column": c, "now": now[c], "change": None if before.get(c) is None or now[c] is None else now[c] - before[c]} for c in columns]


def traction(comments: DataFrame, own: list[str]) -> DataFrame:
    """Rows (repo, kind, login) of others than our own authors, counted; a null login is someone else's."""
    others = comments.where(~F.coalesce("login", F.lit("")).isin(*own))
    return others.groupBy("repo", "kind").agg(F.count("*").alias("n"), F.count_distinct("login").alias("people"))
