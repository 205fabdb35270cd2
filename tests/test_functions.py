import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.functions import text as X


def value(spark, column, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(d,) for d in data], schema).select(column).collect()]


def test_normalize(spark):
    assert value(spark, X.normalize_text(F.col("x")), ["  A \tB\u001cC\n", None, "", " Ünï X "]) == ["a b c", "", "", "ünï x"]
    assert value(spark, X.normalize_sql(F.col("x")), ["SELECT 1 -- x\nFROM /* a\nb */ T", None]) == ["select 1 from t", ""]
    assert value(spark, X.description_key(F.col("x")), ["  A  b\n", None]) == ["a  b", ""]


def test_shingles_and_jaccard(spark):
    assert value(spark, X.shingles(F.col("x")), ["", "a b", "a b c d", "a a a a"]) == [[], ["a b"], ["a b c", "b c d"], ["a a a"]]
    df = spark.createDataFrame([([], []), (["x"], ["x"]), (["x", "y"], ["y", "z"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 1 / 3]


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=50))
@settings(max_examples=100, deadline=None)
def test_permutations_are_exact(hashes):
    pairs = X.permutations(8)
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*pairs))
    got = X.permuted(np.array(hashes, np.uint64)[None, :], a, b)
    assert got.tolist() == [[(p * h + q) % X.PRIME for h in hashes] for p, q in pairs]


def test_signature(spark):
    df = spark.createDataFrame([(["a b c", "b c d"],), ([],)], "s array<string>")
    got = [r[0] for r in df.select(X.signature(F.col("s"))).collect()]
    hashes = [zlib.crc32(x) for x in (b"a b c", b"b c d")]
    assert got == [[min((a * h + b) % X.PRIME for h in hashes) for a, b in X.permutations()], None]


def test_small_rules(spark):
    assert value(spark, X.clean_repo(F.col("x")), ["x.git).", "abcdef0123456789", "foo-", "ok", "..", "a.GIT"]) == ["x", None, None, "ok", None, "a"]
    assert value(spark, X.exists_state(F.col("x")), [200, 301, 404, 429, 500, None], "x int") == [True, True, False, None, None, None]
    assert [t is not None for t in value(spark, X.parsed_time(F.col("x")), ["2024-01-02T03:04:05.000Z", "2024", "", None, "2024-01-02 10:00:00+02:00", "2024-99-01"])] == [True, False, False, False, True, False]
    assert value(spark, X.absent(F.col("x")), [None, "", "a"]) == [True, True, False]
    ci = spark.range(1).select(X.wald(F.lit(0.4), F.lit(5))).first()[0]
    assert abs(ci - 42.941448508405024) < 1e-12
    rows = spark.createDataFrame([("0", None, None), (None, "t", None), (None, None, None)], "id string, task_id string, z string").withColumn("i", F.lit(2))
    assert [r[0] for r in rows.select(X.record_id(rows.columns, F.col("i"))).collect()] == ["0", "t", "row_2"]
