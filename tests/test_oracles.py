"""Every query against the SQL that gives its rows, on the tables of the test scale."""

import glob
import os
import zlib
from collections import Counter

import duckdb
import pytest

from corpuslens.functions.text import PRIME, permutations
from corpuslens.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


def bag(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.columns, got) == bag(names, want.fetchall())


def shingle_crcs(text):
    w = (text or "").lower().split()
    return {zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))} if w else set()


def test_shingle_hashes(spark, sf_dir, db):
    want = [(i, min(h, default=None), max(h, default=None)) for i, t in db.execute("SELECT doc_id, text FROM documents").fetchall() for h in [shingle_crcs(t)]]
    assert Counter(map(tuple, QUERIES["shingle_hashes"](spark, sf_dir).collect())) == Counter(want)


def test_lsh_signature(spark, sf_dir, db):
    """All bands of each distinct text, named by its first document."""
    first = {}
    for i, t in db.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        first.setdefault(" ".join((t or "").lower().split()), i)
    want = set()
    for t, i in first.items():
        if t:
            sig = [min((a * h + b) % PRIME for h in shingle_crcs(t)) for a, b in permutations()]
            want |= {(i, b, "-".join(map(str, sig[4 * b : 4 * b + 4]))) for b in range(len(sig) // 4)}
    assert {tuple(r) for r in QUERIES["lsh_signature"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("name, exact", [("lsh_pairs", "near_pairs_exact"), ("lsh_leak", "leak_near")])
def test_lsh_finds_what_is_there(spark, sf_dir, name, exact):
    """A subset of the exact pairs with the same scores, and nine of ten of them at least."""
    got, want = ({(r["i"], r["j"], round(r["score"], 9)) for r in QUERIES[q](spark, sf_dir).collect()} for q in (name, exact))
    assert want and got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("name", ["leak_shared_groups", "pinned_year_rates"])
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
