import random
import time
import zlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import census as C
from corpuslens.operators import clusters as K
from corpuslens.operators import curve as V
from corpuslens.operators import duplicates as D
from corpuslens.operators import leak as L
from corpuslens.operators import profile as P
from corpuslens.operators import similarity as S
from corpuslens.operators.components import connected_components
from corpuslens.operators.ordering import positioned
from corpuslens.session import BATCH, BATCH_SETTING, SHUFFLE_CLEANUP, stage


def corpus(n, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(n // 3)]
    out = []
    for k in range(n):
        words = list(base[k % len(base)])
        if words and rng.random() < 0.7:
            words[rng.randrange(len(words))] = rng.choice("abcdefghij")
        out.append((k, " ".join(words)))
    return out


def sets(text):
    w = text.split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(left, right, t):
    return {(i, j) for i, a in left for j, b in right if sets(a) and sets(b) and len(sets(a) & sets(b)) / len(sets(a) | sets(b)) >= t}


def test_exact_pairs_are_all_pairs(spark):
    rows = corpus(90, 1)
    df = spark.createDataFrame(rows, "row_idx long, text string")
    side, members = S.classes(df, "text", "row_idx"), {r["row"]: r["class_id"] for r in S.members(df, "text", "row_idx").collect()}
    for t in (0.3, 0.5, 0.7, 1.0):
        got = {(r["i"], r["j"]) for r in S.exact_pairs(side, t).collect()}
        want = {tuple(sorted((members[i], members[j]))) for i, j in brute(rows, rows, t) if i < j and members[i] != members[j]}
        assert got == want
        total = S.counted_pairs(S.exact_pairs(side, t), side).first()["row_pairs"]
        assert total == sum(i < j for i, j in brute(rows, rows, t))
    banded = {(r["i"], r["j"]) for r in S.banded_pairs(side, 0.5).collect()}
    assert banded <= {(r["i"], r["j"]) for r in S.exact_pairs(side, 0.5).collect()}


def test_cross_pairs(spark):
    a, b = corpus(40, 2), [(100 + i, t) for i, t in corpus(30, 2)]
    va, vb = (S.classes(spark.createDataFrame(x, "row_idx long, text string"), "text", "row_idx") for x in (a, b))
    first_a, first_b = {}, {}
    for rows, first in ((a, first_a), (b, first_b)):
        for i, t in rows:
            first.setdefault(t, i)
    want = {(first_a[dict(a)[i]], first_b[dict(b)[j]]) for i, j in brute(a, b, 0.6)}
    assert {(r["i"], r["j"]) for r in S.exact_pairs(va, 0.6, vb).collect()} == want


def test_bucket_cap(spark):
    df = spark.createDataFrame([(k, ["x y z"], 1) for k in range(21)], "id long, shingles array<string>, records long")
    assert S.banded_candidates(df, cap=20).count() == 190


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_components(spark, edges):
    label = list(range(31))
    for a, b in edges:
        lo, hi = sorted((label[a], label[b]))
        label = [lo if x == hi else x for x in label]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {n: got.get(n, n) for n in range(31)} == dict(enumerate(label))


def test_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


def test_classified(spark):
    rows = [(0, "t", "a"), (1, "t", "a"), (2, "u", "a"), (3, "u", "b"), (4, "v", None), (5, "v", None), (6, "w", "c"), (7, "w", "C")]
    df = spark.createDataFrame(rows, "row_idx long, text string, answer string")
    side = S.classes(df, "text", "row_idx")
    clustered = K.clusters(S.exact_pairs(side, 0.7), S.members(df, "text", "row_idx"))
    got = {r["cluster_id"]: r["identical"] for r in K.classified(clustered, df, "row_idx", ["text", "answer"]).collect()}
    assert got == {0: True, 2: False, 4: True, 6: False}


def test_duplicates(spark):
    df = spark.createDataFrame([(0, "", None), (1, "", "x"), (2, "a", "x"), (3, "a", " "), (4, "b", "y")], "row_idx long, k string, g string")
    assert [tuple(r) for r in D.exact_groups(df, F.col("k"), "row_idx").collect()] == [(2, 2)]
    assert {r["row_idx"]: r["reasons"] for r in D.degenerate(df, "row_idx", "k", None, "g").collect()} == {0: ["empty_text", "empty_group"], 1: ["empty_text"], 3: ["empty_group"]}
    g = spark.createDataFrame([(0, "x"), (1, "x"), (2, None)], "row_idx long, g string")
    s = D.distribution_summary(D.distribution(g, "g", "row_idx")).first()
    assert (s["distinct_values"], s["mean_records"], round(s["top_share"], 4)) == (2, 1.5, 0.6667)


def test_leak_needs_one_source_record(spark):
    a = L.keyed(spark.createDataFrame([(0, "q1", "a1"), (1, "q2", "a2")], "row_idx long, t string, a string"), "row_idx", "t", "a")
    b = L.keyed(spark.createDataFrame([(0, "Q1 ", "a2")], "row_idx long, t string, a string"), "row_idx", "t", "a")
    assert {r["what"]: r["n"] for r in L.leak_counts(a, b).collect()} == {"identical_text": 1, "identical_answer": 1, "identical_both": 0, "shared_groups": 0}


def test_profile(spark):
    lines = spark.createDataFrame([(0, '{"a":1}'), (1, '{"a":"x"}'), (2, '{"a":null,"b":1.0}')], "row_idx long, value string")
    fields = P.fields(lines)
    counts = P.type_counts(fields)
    schema = {r["field"]: (r["majority"], r["present"]) for r in P.schema(counts).collect()}
    assert schema == {"a": ("int", 3), "b": ("float", 1)}
    got = {(r["row"], r["field"], r["issue"], r["got"]) for r in P.issues(lines.select(F.col("row_idx").alias("row"), F.col("value").alias("line")), fields, P.schema(counts), 3).collect()}
    assert got == {(0, "b", "missing_field", None), (1, "b", "missing_field", None), (1, "a", "inconsistent_type", "str"), (2, "a", "inconsistent_type", "NoneType")}


def test_curve_jump(spark):
    curve = spark.createDataFrame([(0.7, 0, 0), (0.6, 1, 1), (0.5, 27, 34)], "threshold double, clusters long, pairs long")
    got = V.density(curve, 52002).orderBy(F.desc("threshold")).collect()
    assert [r["per_1k"] for r in got] == [0.0, 0.019, 0.519] and [r["jump"] and round(r["jump"], 2) for r in got] == [None, None, 27.32]


def test_census(spark):
    items = spark.createDataFrame([(1, "2020-01-02", "2020-01-01", True), (2, "2020-01-02", "2020-01-01", False), (3, "2020-01-01", "2020-01-02", True)], "id long, created string, modified string, broken boolean")
    families = C.families(items)
    assert [tuple(r) for r in families.collect()] == [("2020-01-01", 2, 1)]
    assert C.collapsed_rates(items, families).first()["broken_families"] == 0  # half is no majority
    values = spark.createDataFrame([(k, v) for k, v in enumerate([0, 3, 1, 4, 2])], "id long, v long")
    assert C.upper_median(values, "v", "id").first()[0] == 3
    shares = {r["k"]: r["share"] for r in C.top_shares(values, "v", "id", [2, 100], [100, 5]).collect()}
    assert shares == {1: 0.4, 2: 0.7, 100: 1.0}
    assert [r["position"] for r in positioned(values, [F.col("v").asc()]).orderBy("v").collect()] == [1, 2, 3, 4, 5]
    family = spark.createDataFrame([(k, "f", k, k < 10) for k in range(21)], "id long, family string, created long, broken boolean")
    half = C.family_halves(family).first()
    assert (half["half_size"], half["older_broken"], half["newer_broken"], half["outcome"]) == (10, 10, 0, "older")
    status = spark.createDataFrame([("dead",)] * 2 + [("alive",)] * 3 + [(None,)], "s string")
    rate = C.dead_rates(status, "s").first()
    assert (rate["resolved"], rate["unresolved"], rate["dead_pct"]) == (5, 1, 40.0) and abs(rate["ci"] - 42.941448508405024) < 1e-9
    history = spark.createDataFrame([("d1", 1), ("d2", 2)], "date string, n long")
    assert [tuple(r) for r in C.upserted(history, spark.createDataFrame([("d1", 9)], "date string, n long")).collect()] == [("d2", 2), ("d1", 9)]


def test_stage_leaves_no_shuffle_files(spark):
    """Files of a stage's shuffles must not wait for the driver's garbage collection, which may be late."""
    held = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, setting = held(), spark.conf.get(SHUFFLE_CLEANUP, None)
    out = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "cleanup")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert sorted(r["k"] for r in out.collect()) == list(range(7))


def test_only_classes_of_candidates_are_made_into_sets(spark, monkeypatch):
    """Sets and shingles of all classes are never staged, so that what is written grows with the text and with the pairs."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(30))) for k in range(60)]
    rows.append((60, rows[7][1] + " tail"))
    staged, side = {}, S.staged_classes(spark.createDataFrame(rows, "row_idx long, text string"), "text", "row_idx")

    def counted(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(S, "stage", counted)
    assert [(r["i"], r["j"]) for r in S.exact_pairs(side, 0.7).collect()] == [(7, 60)]
    assert staged["hashed"].count() == 2 and "shared" not in staged
    S.staged_classes(spark.createDataFrame(rows, "row_idx long, text string"), "text", "row_idx")
    assert "shingles" not in staged["classes"].columns


def test_banded_pairs_send_hashes_and_signatures_small_batches(spark, monkeypatch):
    rows = [(k, f"a b c d e f g h {k % 3} x y z {k}") for k in range(12)]
    side, staged = S.staged_classes(spark.createDataFrame(rows, "row_idx long, text string"), "text", "row_idx"), {}

    def counted(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    spark.conf.unset(BATCH_SETTING)
    monkeypatch.setattr(S, "stage", counted)
    got = {(r["i"], r["j"]) for r in S.banded_pairs(side, 0.5).collect()}
    assert got and got <= {(i, j) for i, j in brute(rows, rows, 0.5) if i < j}
    assert spark.conf.get(BATCH_SETTING) == BATCH
    assert dict(staged["bands"].dtypes) == {"id": "bigint", "key": "bigint"} and dict(staged["hashed"].dtypes)["h"] == "array<bigint>"
    crcs = {i: {zlib.crc32(" ".join(w).encode()) for w in sets(t)} for i, t in rows}
    want = {i: [min((a * h + b) % X.PRIME for h in own) for a, b in X.permutations()] for i, own in crcs.items()}
    assert {r["id"]: r["sig"] for r in S.signatures(side).collect()} == want
