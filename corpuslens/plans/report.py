"""Markdown of finished audits."""

from __future__ import annotations


def table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows)]


def bound(method: str) -> list[str]:
    return ["", "Candidates come from MinHash bands and scores are exact, so every count is a lower bound."] if method == "minhash-lsh" else []


def report(s: dict) -> str:
    """One audit."""
    d, p, dist = s["duplicates"], s["rates_pct"], s["distributions"]
    out = [f"# Integrity of {s['name']}", "", f"{s['records']} records of `{s['source']}`; roles: {s['roles']}.", ""]
    if "distinct_groups" in dist:
        out += [f"{dist['distinct_groups']} values of `{dist['group_field']}`, {dist['items_per_group_mean']} records each in the mean; the largest has {100 * dist['top_group_share']:.1f} %.", ""]
    for label in s["roles"]["labels"]:
        out += [*table([label, "records"], [[k, v] for k, v in dist[label].items()]), ""]
    out += table(
        ["check", "groups", "records", "%"],
        [
            ["malformed lines", "", s["malformed_lines"], ""], ["schema issues", "", s["schema_issues"], ""], ["degenerate", "", s["degenerate_records"], ""],
            ["same text", d["exact_duplicate_text_groups"], d["exact_duplicate_text_records"], p["exact_duplicate_text"]],
            ["same answer", d["exact_duplicate_answer_groups"], d["exact_duplicate_answer_records"], ""],
            [f"alike at {s['similarity_threshold']}", d["near_duplicate_clusters"], d["records_in_clusters"], p["records_in_clusters"]],
            ["of these redundant: equal in every field", d["fully_identical_clusters"], d["records_fully_identical"], p["fully_identical"]],
            ["of these variants of a stem", d["shared_stem_variant_clusters"], d["records_in_clusters"] - d["records_fully_identical"], ""],
        ],
    )
    return "\n".join([*out, "", f"Search: {s['similarity_method']}, {s['candidate_pairs_examined']} pairs.", *bound(s["similarity_method"]), ""])


def leak_report(s: dict) -> str:
    """One contamination check."""
    a, b, shared = s["a"], s["b"], s["shared_group_count"]
    out = [f"# {b['name']} in {a['name']}", "", f"{a['records']} and {b['records']} records.", ""]
    out += table(
        ["check", f"records of {b['name']}", "%"],
        [
            ["same text", s["exact_text_matches"], s["exact_text_pct_of_b"]], ["same answer", s["exact_answer_matches"], s["exact_answer_pct_of_b"]],
            ["both, from one record: can be answered by heart", s["text_and_answer_matches"], s["text_and_answer_pct_of_b"]],
            [f"text alike at {s['similarity_threshold']}", s["b_records_with_near_match"], s["b_records_with_near_match_pct"]],
        ],
    )
    if shared == 0:
        out += ["", "The splits share no group: likeness is of wording, over different sources."]
    elif shared:
        out += ["", f"The splits share {shared} groups: matches may be of the same item."]
    return "\n".join([*out, "", f"Search: {s['similarity_method']}, {s['candidate_pairs_examined']} pairs.", *bound(s["similarity_method"]), ""])


def comparison(rows: list[dict]) -> str:
    """Audits side by side."""
    keys = ["name", "records", "schema", "degenerate", "identical", "identical_pct", "variant_clusters", "groups", "top_share", "method"]
    return "\n".join(["# Comparison", "", *table(keys, [[r[k] for k in keys] for r in rows]), ""])
