"""Text, set and hash functions as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode and the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Prime modulus of the MinHash permutations.
PRIME = (1 << 61) - 1


def normalize_text(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SPACE, " "))


def normalize_sql(c: Column) -> Column:
    """As normalize_text, without line and block comments. Literals aren't respected."""
    return normalize_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)--[^\n]*|/\*.*?\*/", " "))


def strip(c: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def description_key(c: Column) -> Column:
    """Trimmed and lower-cased, inner white space kept."""
    return F.lower(strip(c))


def flat_text(c: Column) -> Column:
    """An array of strings as one text."""
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")


def shingles(norm: Column, n: int = 3) -> Column:
    """Distinct n-word windows of a normalized text; a shorter text is one shingle, an empty one has none."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))

    own = F.transform(F.array(F.split(norm, " ")), windows)[0]
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.array_distinct(own))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def crc(c: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(c.cast("binary"))


def permutations(n: int = 128, seed: int = 20260824) -> list[tuple[int, int]]:
    """Coefficients from a 64-bit linear congruential generator."""
    state, out = seed, []
    for _ in range(n):
        pair = []
        for low in (1, 0):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            pair.append((state >> 17) % (PRIME - low) + low)
        out.append(tuple(pair))
    return out


def permuted(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a * h + b) mod PRIME for h below 2**32, a and b below 2**47, without overflow or division: the product is taken in two parts, and what lies above 61 bits is added below."""
    m, over = np.uint64(PRIME), np.uint64(61)
    high = h * (a >> np.uint64(30))
    out = h * (a & np.uint64((1 << 30) - 1))
    out += high >> np.uint64(31)
    high &= np.uint64((1 << 31) - 1)
    high <<= np.uint64(30)
    out += high
    out += b
    high = out >> over
    out &= m
    out += high
    return np.minimum(out, out - m, out=out)  # below zero is a large number


def least_permuted(h: list[int] | np.ndarray, a: np.ndarray, b: np.ndarray, run: int = 256) -> np.ndarray | None:
    """The least of each permutation over hashes h, a run of them at a time, which fits a core's cache; None for no hashes."""
    out = None
    for at in range(0, len(h), run):
        own = permuted(np.asarray(h[at : at + run], np.uint64)[None, :], a, b).min(axis=1)
        out = own if out is None else np.minimum(out, own)
    return None if out is None else out.astype(np.int64)


def coefficients(n: int = 128, seed: int = 20260824) -> tuple[np.ndarray, np.ndarray]:
    """permutations() as two columns."""
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*permutations(n, seed)))
    return a, b


def signature(shingle_set: Column, n: int = 128, seed: int = 20260824) -> Column:
    """MinHash signature of a set of strings; null for an empty set. Shingles are hashed by Spark, permuted in numpy over Arrow batches."""
    a, b = coefficients(n, seed)

    @F.pandas_udf("array<long>")
    def least(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda h: least_permuted(h, a, b))

    return least(F.transform(shingle_set, crc))


def record_id(columns: list[str], row: Column, keys: tuple[str, ...] = ("instance_id", "id", "task_id", "_id")) -> Column:
    """First key that isn't null, else row_<position>."""
    return F.coalesce(*(F.col(k).cast("string") for k in keys if k in columns), F.concat(F.lit("row_"), row.cast("string")))


def parsed_time(c: Column) -> Column:
    """ISO-8601 with a date of four, two and two digits, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(c))


def repo_name(c: Column) -> Column:
    """What follows the first slash, lower-cased."""
    return F.lower(F.regexp_replace(c, "^[^/]*/", ""))


def publisher(c: Column) -> Column:
    """What comes before the first slash."""
    return F.substring_index(c, "/", 1)


def absent(c: Column, kind: str = "string") -> Column:
    """Null, empty, false or zero."""
    empty = {"string": c == "", "array": F.size(c) == 0, "map": F.size(c) == 0, "number": c == 0, "boolean": ~c}[kind]
    return c.isNull() | empty


# Link pattern, site pages, categories and the punctuation that abuts links, which results depend on.
REPO = r"(?i)(?<![.\w])github\.com/([A-Za-z0-9][A-Za-z0-9_.-]{0,38})/([A-Za-z0-9_.-]{1,100})"
SITE_PAGES = (
    "about", "features", "pricing", "explore", "topics", "collections", "trending", "marketplace", "sponsors", "readme", "orgs", "site",
    "settings", "notifications", "search", "login", "join", "blog", "apps", "security", "enterprise", "issues", "pulls", "new",
)
ML_CATEGORIES = ("cs.LG", "cs.CV", "cs.CL", "cs.AI", "cs.NE", "stat.ML", "cs.IR", "cs.RO", "cs.MM", "cs.SD", "eess.AS", "eess.IV")
LINK_PUNCTUATION = ".,;:)]}'\""


def clean_repo(c: Column) -> Column:
    """A repository name without punctuation at its end, then without .git; null for what can't be one."""
    name = F.regexp_replace(F.rtrim(c, F.lit(LINK_PUNCTUATION)), r"(?i)[.]git$", "")
    bad = name.isin("", ".", "..") | name.rlike("(?i)^[0-9a-f]{16,}$") | name.rlike("[-_]$")
    return F.when(~bad, name)


def slug_ok(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def exists_state(code: Column) -> Column:
    """True for 2xx and 3xx, false for 404 alone, null for all else: unknown is never dead."""
    return F.when(code.between(200, 399), True).when(code == 404, False)


def remote_class(host_ok: Column, dns_ok: Column, code: Column, error: Column) -> Column:
    """Class of a recorded probe."""
    return (
        F.when(~F.coalesce(host_ok, F.lit(False)), "bad_url")
        .when(~F.coalesce(dns_ok, F.lit(False)), "dns")
        .when(code == 404, "http_404")
        .when(code.isin(401, 403), "auth")
        .when(code.isNotNull(), "ok")
        .when(error == "tls", "tls")
        .otherwise("timeout")
    )


def wald(p: Column, n: Column) -> Column:
    """Half-width of the 95 % interval of a share, in per cent."""
    return F.lit(1.96) * F.sqrt(p * (F.lit(1.0) - p) / n) * 100
