import json

import pytest
from pyspark.sql import functions as F

from corpuslens.__main__ import main
from corpuslens.plans import census
from corpuslens.plans.roles import resolve
from corpuslens.sources import records, registry
from corpuslens.streaming import incremental


def test_load_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{bad\n{"a":2}\n3\n')
    good, bad = records.load_jsonl(spark, str(tmp_path / "x.jsonl"))
    assert sorted((r["row_idx"], r["value"]) for r in good.collect()) == [(0, '{"a":1}'), (1, '{"a":2}')]
    assert sorted(r[0] for r in bad.collect()) == [3, 5]


def test_roles():
    roles, notes = resolve(["question", "query"], "spider")
    assert (roles.text, roles.answer, roles.group) == ("question", "query", None) and len(notes) == 1
    with pytest.raises(ValueError, match="there are: x"):
        resolve(["x"])


def test_command_line(spark, tmp_path):
    rows = [{"question": f"how many items of kind {k % 4} are there in stock now", "answer": f"select {k % 2} -- c", "tags": ["x", 1]} for k in range(8)] + [{"question": "", "answer": None}]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    out = str(tmp_path)
    assert main(["prep", "--data", str(path), "--out-dir", out, "--answer-field", "answer"]) == 0
    s = json.loads((tmp_path / "summary.json").read_text())
    d = s["duplicates"]
    assert (s["records"], d["exact_duplicate_text_groups"], d["exact_duplicate_text_records"], s["degenerate_records"], s["candidate_pairs_examined"]) == (9, 4, 8, 1, 36)
    assert d["fully_identical_clusters"] + d["shared_stem_variant_clusters"] == d["near_duplicate_clusters"]
    assert s["schema_issues"] == 2  # one record lacks tags and has no answer
    assert "Integrity of" in (tmp_path / "REPORT.md").read_text()
    assert main(["leak", "--a", str(path), "--b", str(path), "--out-dir", out, "--answer-field", "answer"]) == 0
    leak = json.loads((tmp_path / "leak_summary.json").read_text())
    assert leak["exact_text_matches"] == leak["text_and_answer_matches"] == 8 and leak["candidate_pairs_examined"] == 81
    assert main(["curve", "--data", str(path), "--out-dir", out, "--thresholds", "0.7,0.5"]) == 0
    assert [r["threshold"] for r in json.loads((tmp_path / "curve.json").read_text())["curve"]] == [0.7, 0.5]
    assert main(["compare", f"{out}/summary.json", "--out", f"{out}/C.md"]) == 0


def test_registry(spark, tmp_path):
    meta = lambda latest, status="active": {registry.META: {"status": status, "isLatest": latest, "publishedAt": "2024-01-01"}}
    entry = lambda n, latest, **kw: {"server": {"name": n, "description": "Same text", **kw}, "_meta": meta(latest)}
    first = {"servers": [entry("p/a", False), entry("p/a", False), entry("p/a", True, remotes=[{"type": "sse", "url": "u1"}, {"type": "sse", "url": ""}], repository={})], "metadata": {"nextCursor": "c2"}}
    second = {"servers": [entry("q/b", True, packages=[{"registryType": "npm", "identifier": "x"}], description="Other")], "metadata": {"nextCursor": "gone"}}
    (tmp_path / "first.json").write_text(json.dumps(first))
    (tmp_path / "c2.json").write_text(json.dumps(second))
    versions = registry.read_registry(spark, str(tmp_path))
    got = census.registry_census(versions, "2024-01-02")
    assert (got["version_records"], got["distinct_servers"], got["publishers"], got["max_versions_one_server"], got["no_repository"]) == (4, 2, 2, 3, 2)
    assert (got["dup_desc_naive_pct"], got["dup_desc_correct_pct"]) == (75.0, 0.0)
    assert [r["url"] for r in registry.remotes(versions).collect()] == ["u1"]
    assert [tuple(r) for r in registry.packages(versions).collect()] == [("npm", "x")]
    with pytest.raises(Exception, match="gone"):
        registry.read_registry(spark, str(tmp_path), failfast=True).collect()
    health = census.remote_health(registry.remotes(versions), spark.createDataFrame([("u1", True, True, 404, None)], "url string, host_ok boolean, dns_ok boolean, code int, error string"))
    assert health["by_class"] == {"http_404": 1} and health["servers_without_remote"] == 1


def test_spaces(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,author,sdk,likes,private,stage,hardware,created_at,last_modified\nu/App,u,gradio,0,F,RUNTIME_ERROR,,2024-02-01T00:00:00Z,2024-01-01T00:00:00Z\nv/app,v,gradio,0,F,SLEEPING,,2024-02-02T00:00:00Z,2024-01-01T00:00:00Z\nw/x,w,static,0,F,RUNNING,,2024-01-01T00:00:00Z,2024-01-01T00:00:00Z\ny/z,y,,0,F,RUNNING,,bad,\n")
    got = census.clone_detect(records.load_spaces(spark, str(tmp_path / "s.csv")))
    assert (got["items"], got["copies"], got["families"], got["broken_families"], got["top_names"]) == (2, 2, 1, 0, [("app", 2)])


def test_links(spark):
    papers = spark.createDataFrame(
        [("1", "cs.LG math.CO", "See https://github.com/Ab/Cd.git). and gist.github.com/a/b", "raw.github.com/x/y", [("v2", "Tue, 2 Jan 2024 00:00:00 GMT"), ("v1", "Mon, 1 Jan 2024 00:00:00 GMT")]), ("2", "math.CO", None, "github.com/ab/cd github.com/about/x", [])],
        "id string, categories string, abstract string, comments string, versions array<struct<version: string, created: string>>",
    )
    found, repos = census.link_extract(papers)
    assert sorted((r["arxiv_id"], r["slug"], r["is_ml"], str(r["date"])[:10]) for r in found.collect()) == [("1", "Ab/Cd", True, "2024-01-01"), ("2", "ab/cd", False, "None")]
    assert [(r["slug_lc"], r["papers"], r["is_ml"]) for r in repos.collect()] == [("ab/cd", 2, True)]


def test_link_analysis(spark):
    sample = spark.createDataFrame([("a", 2010), ("b", 2015), ("c", 2016), ("d", 2016)], "slug string, year int")
    results = spark.createDataFrame([("a", "dead", None, 0), ("a", "alive", True, 1), ("b", "dead", None, 2), ("c", "alive", False, 3)], "slug string, status string, archived boolean, line_no long")
    got = census.link_analyze(sample, results)
    assert got["all"]["dead"] == 1 and got["all"]["unresolved"] == 1 and got["archived_share"] == 0.5 and got["spearman"] == pytest.approx(-1.0)
    assert [r[0] for r in census.to_resolve(sample, results).collect()] == []


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a b",), ("A  b ",), ("c",), ("",)], "text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    incremental.write_counts(incremental.digests(stream, "text"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert sorted(r["records"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_queries_have_rows(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("norm_text", "dup_totals", "class_histogram"):
        assert entry.queries()[name](spark, sf_dir).limit(1).count() == 1


def test_commands(spark, tmp_path, capsys):
    """Each census from recorded files, and what is kept over runs."""
    from corpuslens.__main__ import main
    from corpuslens.sources import sinks

    meta = {registry.META: {"status": "active", "isLatest": True, "publishedAt": "2024-01-01"}}
    entry = lambda name, **more: {"server": {"name": name, "description": "d", "version": "1", **more}, "_meta": meta}
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/first.json").write_text(json.dumps({"servers": [entry("p/a", remotes=[{"type": "sse", "url": "u1"}, {"type": "sse", "url": "u2"}]), entry("p/b", websiteUrl="w"), entry("q/c", packages=[{"registryType": "npm", "identifier": "x"}])], "metadata": {}}))
    versions = registry.read_registry(spark, f"{tmp_path}/pages")
    assert sorted(map(tuple, census.transport_table(versions).collect())) == [("package npm", 1, 1 / 3), ("remote sse", 1, 1 / 3), ("website", 1, 1 / 3)]
    at = lambda name: f"{tmp_path}/{name}"
    run = lambda *argv: main(list(argv))
    read = lambda name: json.loads((tmp_path / name).read_text())
    run("fetch-registry", "--pages", at("pages"), "--out", at("registry"))
    assert spark.read.json(at("registry/latest")).count() == 3
    for day, servers in (("2024-01-01", None), ("2024-01-02", 0), ("2024-01-02", 0)):
        run("registry-census", "--pages", at("pages"), "--date", day, "--history", at("history"), "--out", at("census.json"))
        assert next(c for c in read("census.json")["changes"] if c["column"] == "distinct_servers")["change"] == servers
    assert [r["date"] for r in spark.read.option("header", True).csv(at("history")).orderBy("date").collect()] == ["2024-01-01", "2024-01-02"]
    (tmp_path / "probes.json").write_text('{"url":"u1","host_ok":true,"dns_ok":true,"code":404}\n{"url":"u2","host_ok":true,"dns_ok":true,"code":200}\n')
    run("remote-health", "--pages", at("pages"), "--probes", at("probes.json"), "--out", at("health.json"))
    assert read("health.json")["by_class"] == {"http_404": 1, "ok": 1} and read("health.json")["servers_without_remote"] == 0
    (tmp_path / "checks.json").write_text('{"registry":"npm","identifier":"x","code":404}\n')
    run("dead-packages", "--pages", at("pages"), "--checks", at("checks.json"), "--out", at("dead.json"))
    assert read("dead.json")["npm"]["missing"] == 1
    (tmp_path / "s.csv").write_text("id,author,sdk,likes,private,stage,hardware,created_at,last_modified\nu/App,u,gradio,3,F,RUNTIME_ERROR,,2024-02-01T00:00:00Z,2024-01-01T00:00:00Z\nv/app,v,gradio,0,F,SLEEPING,,2024-02-02T00:00:00Z,2024-01-01T00:00:00Z\ny/z,y,,x,F,SLEEPING,,bad,\n")
    run("clone-detect", "--data", at("s.csv"), "--out", at("clones.json"))
    assert (read("clones.json")["items"], read("clones.json")["skipped"]) == (2, 1)
    run("clone-experiment", "--data", at("s.csv"), "--out", at("experiment.json"))
    run("published-tables", "--data", at("s.csv"), "--out", at("tables.json"))
    assert read("tables.json")["stage"][0] == ["SLEEPING", 2, 2 / 3] and read("tables.json")["unliked"] == 2
    (tmp_path / "models.json").write_text('{"dl30":5,"likes":1,"hascard":true,"lic_c":"mit"}\n7\n{bad\n{"dl30":0}\n')
    run("models-census", "--data", at("models.json"), "--out", at("models_out.json"))
    assert read("models_out.json")["models"] == 2
    for name, lines in (("slugs.json", ['{"slug":"a/b"}', '{"slug":"c/d"}', '{"slug":"e/f"}']), ("codes.json", ['{"slug":"a/b","found":true,"archived":false}', '{"slug":"c/d","found":false,"error":"NOT_FOUND"}'])):
        (tmp_path / name).write_text("\n".join(lines))
    for _ in range(2):  # what is resolved isn't asked for again
        run("link-resolve", "--slugs", at("slugs.json"), "--codes", at("codes.json"), "--results", at("results"))
    assert sorted((r["slug"], r["status"]) for r in sinks.load_results(spark, at("results")).collect()) == [("a/b", "alive"), ("c/d", "dead")]
    spark.createDataFrame([("a/b", 2014), ("c/d", 2016), ("e/f", 2016)], "slug string, year int").write.parquet(at("sample"))
    run("link-analyze", "--sample", at("sample"), "--results", at("results"), "--out", at("links.json"))
    assert read("links.json")["all"]["dead"] == 1
    papers = [("1", "cs.LG", "github.com/ab/cd", "", [("v1", "Mon, 1 Jan 2024 00:00:00 GMT")])]
    spark.createDataFrame(papers, "id string, categories string, abstract string, comments string, versions array<struct<version: string, created: string>>").write.parquet(at("papers"))
    run("link-extract", "--data", at("papers"), "--out", at("links"))
    assert spark.read.parquet(at("links/repositories")).count() == 1 and spark.read.option("header", True).csv(at("links/cohorts")).first()["year"] == "2024"
    (tmp_path / "figures.json").write_text('{"date":"2024-01-01","stars":3}')
    run("traction", "--figures", at("figures.json"), "--history", at("traction"))
    assert '"stars"' in capsys.readouterr().out


def test_missing_pages_and_roles(spark, tmp_path):
    from corpuslens.plans.roles import guessed

    (tmp_path / "other.json").write_text("{}")
    assert registry.read_registry(spark, str(tmp_path)).collect() == []
    assert guessed(["prompt", "domain"]).group == "domain"
