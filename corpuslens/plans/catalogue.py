"""All queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import census as C
from corpuslens.operators import clusters as K
from corpuslens.operators import curve as V
from corpuslens.operators import duplicates as D
from corpuslens.operators import leak as L
from corpuslens.operators import profile as P
from corpuslens.operators import similarity as S
from corpuslens.operators.ordering import keep_last, positioned
from corpuslens.plans import census
from corpuslens.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 0.7
THRESHOLDS = [0.7, 0.6, 0.5, 0.4, 0.3]


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{SPACES}', ' ', 'g'))"


def norm_code(x: str) -> str:
    return norm(rf"regexp_replace(coalesce({x}, ''), '(?s)--[^\n]*|/\*.*?\*/', ' ', 'g')")


def shingled(name: str, where: str = "true") -> str:
    """CTEs c_<name> (id, records), s_<name> (id, sh) and n_<name> (id, n) over documents."""
    return f"""d_{name} AS (SELECT doc_id, {norm("text")} t FROM documents WHERE {where}),
    c_{name} AS (SELECT min(doc_id) id, count(*) records, string_split(t, ' ') w FROM d_{name} WHERE t <> '' GROUP BY t),
    s_{name} AS (SELECT id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda k: array_to_string(list_slice(w, k, k + 2), ' ')))) sh FROM c_{name}),
    n_{name} AS (SELECT id, count(*) n FROM s_{name} GROUP BY id)"""


def pairs_sql(threshold: float) -> str:
    return f"""{shingled("a")},
    x AS (SELECT p.id i, q.id j, count(*) x FROM s_a p JOIN s_a q ON p.sh = q.sh AND p.id < q.id GROUP BY 1, 2),
    pairs AS (SELECT i, j, x / (p.n + q.n - x) AS score FROM x JOIN n_a p ON p.id = i JOIN n_a q ON q.id = j WHERE x / (p.n + q.n - x) >= {threshold})"""


MEMBERS = "m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) class_id FROM d_a WHERE t <> '')"


def clusters_sql(threshold: float) -> str:
    return f"""WITH RECURSIVE {pairs_sql(threshold)}, {MEMBERS},
    e AS (SELECT i u, j v FROM pairs UNION SELECT j, i FROM pairs),
    r AS (SELECT id u, id v FROM c_a UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
    l AS (SELECT u, min(v) component FROM r GROUP BY u),
    q AS (SELECT doc_id, component cluster_id, count(*) OVER (PARTITION BY component) n FROM m JOIN l ON u = class_id),
    clustered AS (SELECT doc_id, cluster_id FROM q WHERE n > 1)"""


def doc_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.staged_classes(table(spark, sf_dir, "documents"), "text", "doc_id")


def doc_clusters(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return K.clusters(S.exact_pairs(doc_classes(spark, sf_dir), threshold), S.members(table(spark, sf_dir, "documents"), "text", "doc_id"))


# scalar functions


@query(f"SELECT doc_id, md5({norm('text')}) AS norm_md5 FROM documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("norm_md5"))


COMMENTED = "concat('SELECT 1 -- ', lang, chr(10), '/* ', source, ' */ FROM ', text)"


@query(f"SELECT doc_id, md5({norm_code(COMMENTED)}) AS norm_md5 FROM documents")
def norm_sql(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_sql(F.expr(COMMENTED))).alias("norm_md5"))


@query(f"WITH {shingled('a')} SELECT m.doc_id, coalesce(n, 0) AS n_shingles FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) class_id FROM d_a) m LEFT JOIN n_a ON id = class_id")
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.shingles(X.normalize_text(F.col("text")))).cast("long").alias("n_shingles"))


@query()
def shingle_hashes(spark, sf_dir):
    own = F.transform(X.shingles(X.normalize_text(F.col("text"))), X.crc)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_min(own).alias("least"), F.array_max(own).alias("largest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN cast(doc_id AS VARCHAR) ELSE concat('row_', doc_id) END AS record_id FROM documents")
def record_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("_id")).select("doc_id", X.record_id(["_id"], F.col("doc_id")).alias("record_id"))


@query("SELECT page_id, lower(regexp_replace(url, '^[^/]*/', '')) AS repo_name, string_split(url, '/')[1] AS publisher FROM pages")
def name_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.repo_name(F.col("url")).alias("repo_name"), X.publisher(F.col("url")).alias("publisher"))


# duplicates, degenerate records, distributions


@query(f"WITH n AS (SELECT doc_id, {norm('text')} k FROM documents) SELECT min(doc_id) AS first_row, count(*) AS records FROM n WHERE k <> '' GROUP BY k HAVING count(*) > 1")
def exact_dup_text(spark, sf_dir):
    return D.exact_groups(table(spark, sf_dir, "documents"), X.normalize_text(F.col("text")), "doc_id")


@query(f"WITH n AS (SELECT p_partkey r, {norm_code('p_name')} k FROM part) SELECT min(r) AS first_row, count(*) AS records FROM n WHERE k <> '' GROUP BY k HAVING count(*) > 1")
def exact_dup_answer(spark, sf_dir):
    return D.exact_groups(table(spark, sf_dir, "part"), X.normalize_sql(F.col("p_name")), "p_partkey")


@query(f"SELECT count(*) AS dup_groups, coalesce(sum(records), 0)::BIGINT AS dup_records FROM (SELECT count(*) records FROM (SELECT {norm('text')} k FROM documents) WHERE k <> '' GROUP BY k HAVING count(*) > 1)")
def dup_totals(spark, sf_dir):
    return D.duplicate_totals(exact_dup_text(spark, sf_dir))


@query(f"SELECT count(*) AS dup_groups, coalesce(sum(records), 0)::BIGINT AS dup_records FROM (SELECT count(*) records FROM (SELECT {norm('text')} k FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 6000)) WHERE k <> '' GROUP BY k HAVING count(*) > 1)")
def truncate_quick_audit(spark, sf_dir):
    """The interactive audit is of the first 6,000 records by definition."""
    head = table(spark, sf_dir, "documents").orderBy("doc_id").limit(6000)
    return D.duplicate_totals(D.exact_groups(head, X.normalize_text(F.col("text")), "doc_id"))


LABELLED = "SELECT d.doc_id, d.text, cast(l.quality AS VARCHAR) quality, CASE WHEN d.doc_id % 10 = 0 THEN ' ' ELSE d.source END source FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(f"SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' END, CASE WHEN quality IS NULL THEN 'empty_answer' END, CASE WHEN trim(source) = '' THEN 'empty_group' END) AS reasons FROM ({LABELLED})) WHERE reasons <> ''")
def degenerate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.withColumn("source", F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("source")))
    return D.degenerate(rows, "doc_id", "text", "quality", "source").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT coalesce(source, '') AS value, count(*) AS records, min(doc_id) AS first_row FROM documents GROUP BY 1")
def group_distribution(spark, sf_dir):
    return D.distribution(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT p_type AS value, count(*) AS records, min(p_partkey) AS first_row FROM part GROUP BY 1 ORDER BY records DESC, first_row LIMIT 20")
def top_groups(spark, sf_dir):
    return D.ordered(D.distribution(table(spark, sf_dir, "part"), "p_type", "p_partkey"), 20)


@query("SELECT coalesce(lang, '') AS value, count(*) AS records, min(doc_id) AS first_row FROM documents GROUP BY 1")
def label_distribution(spark, sf_dir):
    return D.ordered(D.distribution(table(spark, sf_dir, "documents"), "lang", "doc_id"))


@query("SELECT count(*) AS distinct_values, sum(n)::BIGINT / count(*) AS mean_records, max(n) / sum(n)::BIGINT AS top_share FROM (SELECT count(*) n FROM part GROUP BY p_type)")
def top_group_share(spark, sf_dir):
    return D.distribution_summary(D.distribution(table(spark, sf_dir, "part"), "p_type", "p_partkey"))


@query(f"SELECT doc_id, md5({norm('text')}) AS text_norm_md5, {norm_code('lang')} AS answer_norm FROM documents")
def prepared_projection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("text_norm_md5"), X.normalize_sql(F.col("lang")).alias("answer_norm"))


# similarity, clusters, curve


@query(f"WITH d_a AS (SELECT doc_id, {norm('text')} t FROM documents), {MEMBERS} SELECT doc_id AS \"row\", class_id FROM m")
def text_classes(spark, sf_dir):
    return S.members(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"WITH {pairs_sql(THRESHOLD)} SELECT i, j, score FROM pairs")
def near_pairs_exact(spark, sf_dir):
    return S.exact_pairs(doc_classes(spark, sf_dir), THRESHOLD)


@query(f"WITH {pairs_sql(THRESHOLD)} SELECT i, j, score FROM pairs ORDER BY score DESC, i, j LIMIT 25")
def near_pairs_top25(spark, sf_dir):
    return near_pairs_exact(spark, sf_dir).orderBy(F.desc("score"), "i", "j").limit(25)


@query(f"WITH {pairs_sql(THRESHOLD)} SELECT (SELECT count(*) FROM pairs) AS class_pairs, ((SELECT coalesce(sum(p.records * q.records), 0) FROM pairs JOIN c_a p ON p.id = i JOIN c_a q ON q.id = j) + (SELECT sum(records * (records - 1) // 2) FROM c_a))::BIGINT AS row_pairs")
def pair_totals(spark, sf_dir):
    side = doc_classes(spark, sf_dir)
    return S.counted_pairs(S.exact_pairs(side, THRESHOLD), side)


@query(f"{clusters_sql(THRESHOLD)} SELECT doc_id AS \"row\", cluster_id FROM clustered")
def clusters(spark, sf_dir):
    return doc_clusters(spark, sf_dir)


CLASSES = "classes AS (SELECT cluster_id, count(*) AS records, count(DISTINCT [coalesce(text, chr(0)), coalesce(lang, chr(0)), coalesce(source, chr(0))]) = 1 AS identical FROM clustered JOIN documents USING (doc_id) GROUP BY 1)"


@query(f"{clusters_sql(THRESHOLD)}, {CLASSES} SELECT * FROM classes")
def cluster_classes(spark, sf_dir):
    return K.classified(doc_clusters(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source"])


@query(f"{clusters_sql(THRESHOLD)}, {CLASSES} SELECT count(*) AS clusters, sum(records)::BIGINT AS records_in_clusters, count_if(identical)::BIGINT AS identical_clusters, coalesce(sum(records) FILTER (identical), 0)::BIGINT AS identical_records, count_if(NOT identical)::BIGINT AS variant_clusters FROM classes")
def cluster_totals(spark, sf_dir):
    return K.cluster_totals(cluster_classes(spark, sf_dir))


def curve_sql() -> str:
    reach = "\n".join(
        f"""e{k} AS (SELECT i u, j v FROM pairs WHERE score >= {t} UNION SELECT j, i FROM pairs WHERE score >= {t}),
    r{k} AS (SELECT id u, id v FROM c_a UNION SELECT r{k}.u, e{k}.v FROM r{k} JOIN e{k} ON r{k}.v = e{k}.u),
    l{k} AS (SELECT u, min(v) component FROM r{k} GROUP BY u),
    q{k} AS (SELECT count(*) AS n FROM (SELECT component FROM m JOIN l{k} ON u = class_id GROUP BY 1 HAVING count(*) > 1)),
    p{k} AS (SELECT ((SELECT coalesce(sum(p.records * q.records), 0) FROM pairs JOIN c_a p ON p.id = i JOIN c_a q ON q.id = j WHERE score >= {t}) + (SELECT sum(records * (records - 1) // 2) FROM c_a))::BIGINT AS n),"""
        for k, t in enumerate(THRESHOLDS)
    )
    rows = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, (SELECT n FROM q{k}) AS clusters, (SELECT n FROM p{k}) AS pairs" for k, t in enumerate(THRESHOLDS))
    return f"WITH RECURSIVE {pairs_sql(min(THRESHOLDS))}, {MEMBERS}, {reach} curve AS ({rows})"


@query(f"{curve_sql()} SELECT * FROM curve")
def curve(spark, sf_dir):
    side = doc_classes(spark, sf_dir)
    return V.sweep(S.exact_pairs(side, min(THRESHOLDS)), side, THRESHOLDS)


@query(f"{curve_sql()}, per AS (SELECT *, floor(clusters * 1e6::DOUBLE / (SELECT count(*) FROM documents)::DOUBLE + 0.5) / 1000.0::DOUBLE AS per_1k FROM curve), b AS (SELECT *, lag(per_1k) OVER (ORDER BY threshold DESC) AS up FROM per) SELECT threshold, clusters, pairs, per_1k, CASE WHEN up > 0 THEN per_1k / up END AS jump FROM b")
def curve_jump(spark, sf_dir):
    return V.density(curve(spark, sf_dir), table(spark, sf_dir, "documents").count())


@query()
def lsh_signature(spark, sf_dir):
    return S.bands(doc_classes(spark, sf_dir)).select("id", "band", F.array_join(F.col("key").cast("array<string>"), "-").alias("key"))


@query()
def lsh_pairs(spark, sf_dir):
    return S.banded_pairs(doc_classes(spark, sf_dir), THRESHOLD)


@query()
def lsh_leak(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a, b = (S.staged_classes(docs.where(w), "text", "doc_id") for w in ("doc_id % 5 <> 0", "doc_id % 5 = 0"))
    return S.banded_pairs(a, THRESHOLD, other=b)


# contamination: documents whose id is divisible by five are the evaluation split


def splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("grp", F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id") % 3))
    return tuple(L.keyed(docs.where(w), "doc_id", "text", "lang", "grp") for w in ("doc_id % 5 <> 0", "doc_id % 5 = 0"))


KEYED = f"k AS (SELECT doc_id, {norm('text')} t, {norm_code('lang')} a, concat(coalesce(lang, ''), '/', doc_id % 3) g FROM documents), a AS (SELECT * FROM k WHERE doc_id % 5 <> 0), b AS (SELECT * FROM k WHERE doc_id % 5 = 0)"


def witness_sql(*keys: str) -> str:
    by, filled = ", ".join(keys), " AND ".join(f"{k} <> ''" for k in keys)
    return f"WITH {KEYED}, w AS (SELECT {by}, list_sort(list(doc_id))[1:5] ids FROM a WHERE {filled} GROUP BY {by}) SELECT b.doc_id AS \"row\", array_to_string(ids, ',') AS witnesses FROM b JOIN w USING ({by})"


def witnessed(spark, sf_dir, keys):
    a, b = splits(spark, sf_dir)
    return L.matched(a, b, keys).select("row", F.array_join(F.col("witnesses").cast("array<string>"), ",").alias("witnesses"))


@query(witness_sql("t"))
def leak_text(spark, sf_dir):
    return witnessed(spark, sf_dir, ["text_key"])


@query(witness_sql("a"))
def leak_answer(spark, sf_dir):
    return witnessed(spark, sf_dir, ["answer_key"])


@query(witness_sql("t", "a"))
def leak_both(spark, sf_dir):
    return witnessed(spark, sf_dir, ["text_key", "answer_key"])


@query(f"WITH {KEYED} SELECT g AS group_key FROM a INTERSECT SELECT g FROM b")
def leak_shared_groups(spark, sf_dir):
    return L.shared_groups(*splits(spark, sf_dir))


@query(f"""WITH {shingled("a", "doc_id % 5 <> 0")}, {shingled("b", "doc_id % 5 = 0")},
x AS (SELECT p.id i, q.id j, count(*) x FROM s_a p JOIN s_b q ON p.sh = q.sh GROUP BY 1, 2)
SELECT i, j, x / (p.n + q.n - x) AS score FROM x JOIN n_a p ON p.id = i JOIN n_b q ON q.id = j WHERE x / (p.n + q.n - x) >= {THRESHOLD}""")
def leak_near(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a, b = (S.staged_classes(docs.where(w), "text", "doc_id") for w in ("doc_id % 5 <> 0", "doc_id % 5 = 0"))
    return S.exact_pairs(a, THRESHOLD, b)


@query(f"""WITH {KEYED} SELECT 'identical_text' AS what, count(*) AS n FROM b WHERE t <> '' AND t IN (SELECT t FROM a)
UNION ALL SELECT 'identical_answer', count(*) FROM b WHERE a <> '' AND a IN (SELECT a FROM a)
UNION ALL SELECT 'identical_both', count(*) FROM b WHERE t <> '' AND b.a <> '' AND EXISTS (SELECT 1 FROM a z WHERE z.t = b.t AND z.a = b.a)
UNION ALL SELECT 'shared_groups', count(*) FROM (SELECT g FROM a INTERSECT SELECT g FROM b)""")
def leak_summary(spark, sf_dir):
    return L.leak_counts(*splits(spark, sf_dir))


# schema profile: documents as JSON records of uneven shape

RECORDS = """SELECT doc_id, concat('{"doc_id": ', doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(', "lang": "', lang, '"') END,
 ', "n": ', CASE WHEN doc_id % 5 = 0 THEN concat('"', n_chars, '"') WHEN doc_id % 11 = 0 THEN concat(n_chars, '.5') WHEN doc_id % 13 = 0 THEN 'null' ELSE concat(n_chars, '') END,
 CASE WHEN doc_id % 3 = 0 THEN ', "tags": ["a", 1], "meta": {"x": true}' ELSE ', "ok": true' END, '}') AS value FROM documents"""
TYPED = f"""r AS ({RECORDS}), f AS (SELECT doc_id, k AS field, CASE json_type(value, '$.' || k) WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'ARRAY' THEN 'list' ELSE 'dict' END AS py_type FROM (SELECT doc_id, value, unnest(json_keys(value)) k FROM r)),
c AS (SELECT field, py_type, count(*) AS records, min(doc_id) AS first_row FROM f GROUP BY 1, 2),
s AS (SELECT field, arg_max(py_type, [records, -first_row]) AS majority, sum(records)::BIGINT AS present FROM c GROUP BY 1)"""


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECORDS.replace("FROM documents", "FROM {docs}").replace('{"', '{{"').replace('"}', '"}}').replace("true}'", "true}}'").replace("'}'", "'}}'"), docs=table(spark, sf_dir, "documents"))


@query(f"WITH {TYPED} SELECT * FROM c")
def schema_profile(spark, sf_dir):
    return P.type_counts(P.fields(json_records(spark, sf_dir), "doc_id")).drop("first_at")


@query(f"WITH {TYPED} SELECT s.field, (SELECT count(*) FROM r) - present AS missing, coalesce((SELECT sum(records) FROM c WHERE c.field = s.field AND c.py_type <> majority), 0)::BIGINT AS inconsistent FROM s")
def schema_issues(spark, sf_dir):
    counts = stage(P.type_counts(P.fields(json_records(spark, sf_dir), "doc_id")), "types")
    return P.issue_counts(counts, P.schema(counts), table(spark, sf_dir, "documents").count())


@query(f"""WITH {TYPED} SELECT f.doc_id AS "row", f.field, 'inconsistent_type' AS issue, majority AS expected, py_type AS got FROM f JOIN s USING (field) WHERE py_type <> majority
UNION ALL SELECT r.doc_id, s.field, 'missing_field', NULL, NULL FROM r JOIN s ON present < (SELECT count(*) FROM r) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = r.doc_id AND f.field = s.field)""")
def schema_issue_rows(spark, sf_dir):
    rows = json_records(spark, sf_dir)
    fields = stage(P.fields(rows, "doc_id"), "fields")
    return P.issues(rows.select(F.col("doc_id").alias("row"), F.col("value").alias("line")), fields, P.schema(P.type_counts(fields)), rows.count())


# catalogues: line items as items that copy an order's stamp, orders as cohorts, events as a version log

ITEMS = "items AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS family, l_shipdate AS modified, o_orderdate AS created, l_returnflag = 'R' AS broken, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("family"), F.col("l_shipdate").alias("modified"), F.col("o_orderdate").alias("created"), (F.col("l_returnflag") == "R").alias("broken"), "l_partkey")


FAMILIES = "fam AS (SELECT modified AS family, count(*) AS members, count_if(broken)::BIGINT AS broken FROM items WHERE modified < created GROUP BY 1)"


@query(f"WITH {ITEMS}, {FAMILIES} SELECT * FROM fam")
def clone_families(spark, sf_dir):
    return C.families(items(spark, sf_dir))


@query(f"""WITH {ITEMS}, {FAMILIES}, i AS (SELECT count(*) AS items, count_if(broken)::BIGINT AS broken_items, count_if(modified < created)::BIGINT AS copies, count_if(broken AND NOT modified < created)::BIGINT AS bo FROM items),
f AS (SELECT count(*) AS families, count_if(2 * broken > members)::BIGINT AS broken_families FROM fam)
SELECT items, broken_items, copies, families, broken_families, broken_items / items AS raw_rate, (bo + broken_families) / (items - copies + families) AS collapsed_rate, copies / items AS copy_share FROM i, f""")
def clone_dedup_rates(spark, sf_dir):
    own = items(spark, sf_dir)
    return C.collapsed_rates(own, C.families(own))


@query(f"WITH {ITEMS} SELECT lower(p_name) AS name, count(*) AS records FROM items JOIN part ON l_partkey = p_partkey WHERE modified < created GROUP BY 1 ORDER BY records DESC, name LIMIT 6")
def clone_names(spark, sf_dir):
    copies = items(spark, sf_dir).where("modified < created").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return copies.groupBy(X.repo_name(F.concat(F.lit("x/"), "p_name")).alias("name")).agg(F.count("*").alias("records")).orderBy(F.desc("records"), "name").limit(6)


YEARS = list(range(1992, 1999))


@query("SELECT o_orderpriority, " + ", ".join(f"count_if(year(o_orderdate) = {y})::BIGINT AS n_{y}, count_if(year(o_orderdate) = {y} AND o_orderstatus = 'F')::BIGINT AS broken_{y}" for y in YEARS) + " FROM orders GROUP BY 1")
def cohort_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").alias("broken"))
    return C.cohorts(rows, "o_orderpriority", "year", YEARS)


HALVES = f"""{ITEMS}, o AS (SELECT family, broken, row_number() OVER (PARTITION BY family ORDER BY created, id) pos, count(*) OVER (PARTITION BY family) n FROM items),
h AS (SELECT family, cast(n // 2 AS BIGINT) AS half_size, count_if(broken AND pos <= n // 2)::BIGINT AS older_broken, count_if(broken AND pos > n - n // 2)::BIGINT AS newer_broken FROM o WHERE n >= 20 GROUP BY 1, 2),
halves AS (SELECT *, CASE WHEN older_broken > newer_broken THEN 'older' WHEN older_broken < newer_broken THEN 'newer' ELSE 'tie' END AS outcome FROM h)"""


@query(f"WITH {HALVES} SELECT * FROM halves")
def family_halves(spark, sf_dir):
    return C.family_halves(items(spark, sf_dir))


@query(f"WITH {HALVES}, s AS (SELECT coalesce(count_if(outcome = 'older'), 0)::BIGINT AS older, coalesce(count_if(outcome = 'newer'), 0)::BIGINT AS newer, coalesce(count_if(outcome = 'tie'), 0)::BIGINT AS tie FROM halves) SELECT older, newer, tie, CASE WHEN older + newer > 0 THEN (older - (older + newer) / 2.0::DOUBLE) / sqrt((older + newer) / 4.0::DOUBLE) END AS z FROM s")
def sign_test(spark, sf_dir):
    return C.sign_test(family_halves(spark, sf_dir))


@query(f"WITH {ITEMS}, y AS (SELECT month(created)::INTEGER AS family, year(created) y, count(*) members, count_if(broken)::BIGINT broken, min(created) f FROM items GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY members DESC, f) rn FROM y) SELECT family, y::INTEGER AS pinned_year, members, broken FROM b WHERE rn = 1 AND members >= 20")
def pinned_year_rates(spark, sf_dir):
    return C.pinned_year_rates(items(spark, sf_dir).withColumns({"family": F.month("created"), "year": F.year("created")}), "year")


@query("SELECT count(*) AS n, count_if(c_acctbal <= 0)::BIGINT AS not_positive, count_if(coalesce(c_mktsegment, '') = '')::BIGINT AS no_segment FROM customer")
def flag_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") <= 0).alias("not_positive"), F.count_if(X.absent(F.col("c_mktsegment"))).alias("no_segment"))


@query("SELECT coalesce(nullif(nullif(c_mktsegment, ''), 'BUILDING'), 'NONE') AS licence, count(*) AS records FROM customer GROUP BY 1")
def licence_histogram(spark, sf_dir):
    named = F.coalesce(F.nullif(F.nullif(F.col("c_mktsegment"), F.lit("")), F.lit("BUILDING")), F.lit("NONE"))
    return table(spark, sf_dir, "customer").groupBy(named.alias("licence")).agg(F.count("*").alias("records"))


@query("""WITH v AS (SELECT cast(round(o_totalprice * 100) AS BIGINT) v, row_number() OVER (ORDER BY cast(round(o_totalprice * 100) AS BIGINT) DESC, o_orderkey) rn, count(*) OVER () n FROM orders),
k AS (SELECT DISTINCT k FROM (SELECT unnest([10, 100, 1000, 10000]) k UNION SELECT n // 100 FROM v UNION SELECT n // 10 FROM v) WHERE k >= 1)
SELECT k::BIGINT AS k, sum(v) FILTER (rn <= k)::BIGINT / sum(v)::BIGINT AS share FROM v, k GROUP BY k""")
def topk_concentration(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderkey")
    return C.top_shares(rows, "cents", "o_orderkey", [10, 100, 1000, 10000])


@query("WITH v AS (SELECT n_chars v, row_number() OVER (ORDER BY n_chars, doc_id) - 1 rn, count(*) OVER () n FROM documents WHERE n_chars <> 0) SELECT v AS upper_median FROM v WHERE rn = n // 2")
def upper_median(spark, sf_dir):
    return C.upper_median(table(spark, sf_dir, "documents"), "n_chars", "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents")
def running_rank(spark, sf_dir):
    return positioned(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id").asc()]).select("doc_id", "position")


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1)"


@query(f"WITH {LATEST} SELECT user_id, event_id, event_type FROM latest")
def latest_filter(spark, sf_dir):
    return C.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH c AS (SELECT string_split(p_name, ' ')[1] AS p, count(*) AS n FROM part GROUP BY 1)
SELECT count(*) AS publishers, count_if(n = 1)::BIGINT AS singletons, sum(n)::BIGINT AS names, (SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, p LIMIT 10))::BIGINT / sum(n)::BIGINT AS top_share FROM c""")
def publisher_concentration(spark, sf_dir):
    return C.publisher_concentration(table(spark, sf_dir, "part"), X.publisher(F.translate("p_name", " ", "/")))


@query("SELECT max(n) AS max_versions FROM (SELECT count(*) n FROM events GROUP BY user_id)")
def max_versions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_versions"))


SHARE = "SELECT sum(n)::BIGINT AS records, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicated, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT / sum(n)::BIGINT AS share"


@query(f"WITH {LATEST} SELECT 'naive' AS rows_of, * FROM ({SHARE} FROM (SELECT count(*) n FROM events GROUP BY lower(trim(coalesce(props, ''))))) UNION ALL SELECT 'latest', * FROM ({SHARE} FROM (SELECT count(*) n FROM latest GROUP BY lower(trim(coalesce(props, '')))))")
def dup_desc_naive_vs_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    key = X.description_key(F.col("props"))
    naive = C.duplicate_share(events, key).select(F.lit("naive").alias("rows_of"), "*")
    return naive.unionByName(C.duplicate_share(C.latest(events, "user_id", ["ts", "event_id"]), key).select(F.lit("latest").alias("rows_of"), "*"))


@query("SELECT event_type AS transport, count(DISTINCT user_id) AS names, count(*) AS records, count_if(contains(lower(props), '\"k\": 1'))::BIGINT AS template FROM events GROUP BY 1")
def transport_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("transport")).agg(F.count_distinct("user_id").alias("names"), F.count("*").alias("records"), F.count_if(F.contains(F.lower("props"), F.lit('"k": 1'))).alias("template"))


PROBES = "SELECT o_orderkey AS id, o_orderkey % 13 <> 0 AS host_ok, o_orderkey % 11 <> 0 AS dns_ok, CASE WHEN o_orderkey % 7 < 5 THEN CASE cast(o_orderkey % 5 AS INT) WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 401 WHEN 3 THEN 503 ELSE 403 END END AS code, CASE WHEN o_orderkey % 7 = 5 THEN 'tls' ELSE 'slow' END AS error FROM orders"
CLASSED = f"p AS ({PROBES}), q AS (SELECT id, CASE WHEN NOT host_ok THEN 'bad_url' WHEN NOT dns_ok THEN 'dns' WHEN code = 404 THEN 'http_404' WHEN code IN (401, 403) THEN 'auth' WHEN code IS NOT NULL THEN 'ok' WHEN error = 'tls' THEN 'tls' ELSE 'timeout' END AS class FROM p)"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROBES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@query(f"WITH {CLASSED} SELECT * FROM q")
def remote_classify(spark, sf_dir):
    return probes(spark, sf_dir).select("id", X.remote_class(F.col("host_ok"), F.col("dns_ok"), F.col("code"), F.col("error")).alias("class"))


@query(f"WITH {CLASSED} SELECT class, count(*) AS records FROM q GROUP BY 1")
def class_histogram(spark, sf_dir):
    return remote_classify(spark, sf_dir).groupBy("class").agg(F.count("*").alias("records"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error' EXCEPT SELECT user_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'purchase'")
def dead_servers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return C.dead_only(rows, ["user_id", "day"], F.col("event_type") == "error", F.col("event_type") == "purchase")


@query(f"WITH p AS ({PROBES}), e AS (SELECT id % 3 AS registry, CASE WHEN code BETWEEN 200 AND 399 THEN true WHEN code = 404 THEN false END AS ok FROM p) SELECT registry, count(*) AS packages, count_if(ok = false)::BIGINT AS missing, count_if(ok IS NULL)::BIGINT AS unresolved FROM e GROUP BY 1")
def package_missing(spark, sf_dir):
    rows = probes(spark, sf_dir).select((F.col("id") % 3).alias("registry"), X.exists_state(F.col("code")).alias("ok"))
    return rows.groupBy("registry").agg(F.count("*").alias("packages"), F.count_if(~F.col("ok")).alias("missing"), F.count_if(F.col("ok").isNull()).alias("unresolved"))


@query("SELECT DISTINCT event_type || ':' || coalesce(nullif(props, ''), cast(user_id AS VARCHAR)) AS identifier FROM events")
def distinct_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(":"), F.coalesce(F.nullif(F.col("props"), F.lit("")), F.col("user_id").cast("string"))).alias("identifier")).distinct()


LINKED = "concat('code at https://GitHub.com/Owner', doc_id % 7, '/repo', doc_id % 5, '.git). and gist.github.com/a/0123456789abcdef0 or (github.com/about/x) ', CASE WHEN doc_id % 4 = 0 THEN 'github.com/t/cut-' ELSE 'github.com/one/Two_' || (doc_id % 3) || '.' END)"
MENTIONS = "m AS (SELECT doc_id AS arxiv_id, 'Owner' || (doc_id % 7) || '/repo' || (doc_id % 5) AS slug, lang IN ('en', 'de') AS is_ml FROM documents UNION ALL SELECT doc_id, 'one/Two_' || (doc_id % 3), lang IN ('en', 'de') FROM documents WHERE doc_id % 4 <> 0)"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslens.plans.links import mentioned

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("arxiv_id"), F.expr(LINKED).alias("text"), F.lit("2020-01-01").cast("timestamp").alias("date"), F.col("lang").isin("en", "de").alias("is_ml"))
    return mentioned(rows, "text")


@query(f"WITH {MENTIONS} SELECT * FROM m")
def link_mentions(spark, sf_dir):
    return mentions(spark, sf_dir).select("arxiv_id", "slug", "is_ml")


@query(f"WITH {MENTIONS} SELECT lower(slug) AS slug_lc, arg_min(slug, arxiv_id) AS slug, count(DISTINCT arxiv_id) AS papers, bool_or(is_ml) AS is_ml FROM m GROUP BY 1")
def repo_rollup(spark, sf_dir):
    return C.repo_rollup(mentions(spark, sf_dir)).drop("first_date")


@query("SELECT c_custkey, coalesce(r.o_orderstatus, 'unresolved') AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) o_orderstatus FROM orders GROUP BY 1) r ON c_custkey = o_custkey")
def keep_last_left_join(spark, sf_dir):
    last = keep_last(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderstatus", F.lit("unresolved")).alias("status"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P')")
def resume_set(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "dead").when(F.col("o_orderstatus") == "P", "unresolved").otherwise("alive")
    return table(spark, sf_dir, "orders").select(F.greatest(F.year("o_orderdate"), F.lit(1993)).alias("cohort"), status.alias("status"))


STATUSES = "s AS (SELECT greatest(year(o_orderdate), 1993)::INTEGER AS cohort, CASE o_orderstatus WHEN 'F' THEN 'dead' WHEN 'P' THEN 'unresolved' ELSE 'alive' END AS status FROM orders)"
RATES = "count(*) AS n, count_if(status <> 'unresolved')::BIGINT AS resolved, count_if(status = 'dead')::BIGINT AS dead, count_if(status = 'unresolved')::BIGINT AS unresolved"
RATED = "dead / resolved * 100 AS dead_pct, 1.96::DOUBLE * sqrt(dead / resolved * (1.0::DOUBLE - dead / resolved) / resolved) * 100 AS ci"


@query(f"WITH {STATUSES}, g AS (SELECT {RATES} FROM s) SELECT *, {RATED} FROM g WHERE resolved > 0")
def dead_rate_ci(spark, sf_dir):
    return C.dead_rates(statuses(spark, sf_dir), "status")


@query(f"WITH {STATUSES}, g AS (SELECT cohort, {RATES} FROM s GROUP BY 1) SELECT *, {RATED} FROM g WHERE resolved > 0")
def cohort_table(spark, sf_dir):
    return C.dead_rates(statuses(spark, sf_dir), "status", [F.col("cohort")])


@query(f"WITH {STATUSES}, g AS (SELECT cohort, {RATES} FROM s GROUP BY 1), t AS (SELECT *, {RATED} FROM g WHERE resolved > 0), r AS (SELECT rank() OVER (ORDER BY cohort) + (count(*) OVER (PARTITION BY cohort) - 1) / 2.0 AS x, rank() OVER (ORDER BY dead_pct) + (count(*) OVER (PARTITION BY dead_pct) - 1) / 2.0 AS y FROM t) SELECT cast(floor(corr(x, y) * 1e6 + 0.5) AS BIGINT) AS rho_millionths FROM r")
def spearman(spark, sf_dir):
    """In whole millionths: engines sum the ranks in different orders."""
    return C.spearman(cohort_table(spark, sf_dir), "cohort", "dead_pct").select(F.floor(F.col("rho") * 1e6 + 0.5).alias("rho_millionths"))


@query("WITH h AS (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS events FROM events GROUP BY 1), t AS (SELECT max(date) AS date FROM h) SELECT date, events FROM h WHERE date <> (SELECT date FROM t) UNION ALL SELECT date, 0 FROM t")
def history_upsert(spark, sf_dir):
    history = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("events"))
    return C.upserted(history, history.agg(F.max("date").alias("date")).select("date", F.lit(0).cast("long").alias("events")))


@query("WITH h AS (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS events FROM events GROUP BY 1) SELECT date, events, cast(events - lag(events) OVER (ORDER BY date) AS DOUBLE) AS change FROM h")
def drift_lag(spark, sf_dir):
    history = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("events"))
    return C.drift(history, "date", "events").withColumn("change", F.col("change").cast("double"))


@query(f"WITH p AS ({PROBES}) SELECT coalesce(cast(code AS VARCHAR), error) AS reason, count(*) AS records FROM p GROUP BY 1 ORDER BY records DESC, reason LIMIT 10")
def reasons_top10(spark, sf_dir):
    rows = probes(spark, sf_dir).groupBy(F.coalesce(F.col("code").cast("string"), "error").alias("reason")).agg(F.count("*").alias("records"))
    return rows.orderBy(F.desc("records"), "reason").limit(10)


# published tables of a catalogue: order states as stages, kinds and brands of parts as what they declare


@query("SELECT o_orderstatus AS value, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1")
def stage_shares(spark, sf_dir):
    return census.shares(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT w AS transport, count(*) AS servers, count(*) / (SELECT count(*) FROM part) AS share FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_type || ' ' || p_brand), ' ')) w FROM part) GROUP BY 1")
def transport_membership(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    each = parts.select(F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand")), " "))).alias("transport"))
    return census.shares(each, "transport", parts.count()).select(F.col("value").alias("transport"), F.col("n").alias("servers"), "share")


@query("SELECT c_mktsegment AS sdk, count(*) AS n, count_if(c_acctbal < 0)::BIGINT AS broken FROM customer GROUP BY 1")
def sdk_broken(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("sdk")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("broken"))
