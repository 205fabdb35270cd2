"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from corpuslens.llm.repetition import LIMITS, LINE_LIMIT, MIN_WORDS


def repetition_sql() -> str:
    def covered(k: int) -> str:
        return f"""g{k} AS (SELECT doc_id, unnest(range(1, n - {k - 2})) i, unnest(list_transform(range(1, n - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) g FROM t WHERE n >= {k}),
        d{k} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) m FROM g{k}) WHERE m > 1),
        c{k} AS (SELECT doc_id, count(*) words, sum(length(w)) chars FROM (SELECT DISTINCT doc_id, i + o AS i FROM d{k}, range({k}) r(o)) JOIN w USING (doc_id, i) GROUP BY doc_id)"""

    lengths = [3, *LIMITS]
    cover = ", ".join(f"coalesce(c{k}.chars, 0)::BIGINT AS dup_{k}gram_chars" for k in LIMITS)
    within = " AND ".join(f"dup_{k}gram_chars <= {limit}::DOUBLE * word_chars" for k, limit in LIMITS.items())
    joins = " ".join(f"LEFT JOIN c{k} ON c{k}.doc_id = t.doc_id" for k in lengths)
    return rf"""WITH t AS (SELECT *, len(ws) n FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents)),
    w AS (SELECT doc_id, unnest(range(1, n + 1)) i, unnest(ws) w FROM t),
    s AS (SELECT doc_id, sum(length(w)) word_chars FROM w GROUP BY doc_id),
    l AS (SELECT doc_id, unnest(range(len(ls))) i, unnest(ls) l FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM t)),
    r AS (SELECT doc_id, regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') own, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) k FROM l),
    p AS (SELECT doc_id, count(*) n_dup_lines, sum(length(own)) dup_line_chars FROM r WHERE k > 1 AND own <> '' GROUP BY doc_id),
    {", ".join(covered(k) for k in lengths)},
    m AS (SELECT t.doc_id, n::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c3.words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {cover}
        FROM t LEFT JOIN s ON s.doc_id = t.doc_id LEFT JOIN p ON p.doc_id = t.doc_id {joins}),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND dup_line_chars <= {LINE_LIMIT}::DOUBLE * word_chars AND {within} AS kept FROM f"""


#: Characters that rendering adds to a text or role: one for each backslash and control string.
ESCAPES = r"len(regexp_extract_all({0}, '\\|<</SYS>>|\[/INST\]|<<SYS>>|\[INST\]|</s>|<s>|<\|'))"

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + {ESCAPES.format("role")} + length(role) - length(replace(role, chr(10), '')) + length(text) + {ESCAPES.format("text")} + 9) AS formatted FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM g"""

ORACLES: dict[str, str] = {"op5_repetition": repetition_sql(), "op8_chat": CHAT}
