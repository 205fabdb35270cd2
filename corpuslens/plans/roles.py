"""Which columns play which role in an audit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.records import guess_field


@dataclass(frozen=True)
class Roles:
    text: str
    answer: str | None = None
    group: str | None = None
    labels: tuple[str, ...] = ()

    def fields(self) -> list[str]:
        """The columns that identical members have to agree in."""
        return [c for c in (self.text, self.answer, self.group, *self.labels) if c]


# The presets, and the usual names of texts, answers and groups.
PRESETS = {
    "bird-critic": Roles(text="query", answer="issue_sql", group="db_id", labels=("dialect", "category")),
    "spider": Roles(text="question", answer="query", group="db_id"),
    "generic": Roles("question"),
}
TEXT_CANDIDATES = ["question", "prompt", "query", "instruction", "text", "problem", "input", "issue"]
ANSWER_CANDIDATES = ["answer", "canonical_solution", "solution", "sql", "query", "output", "issue_sql", "response", "code"]
GROUP_CANDIDATES = ["db_id", "source", "category", "subject", "domain"]


def resolve(columns: list[str], preset: str = "generic", **given) -> tuple[Roles, list[str]]:
    """The preset's roles with what is given in their place, and notes. A missing text is an error; other missing columns are dropped."""
    roles = replace(PRESETS[preset], **{k: v for k, v in given.items() if v is not None})
    if roles.text not in columns:
        raise ValueError(f"no column {roles.text!r} for the text; there are: {', '.join(sorted(columns))}")
    gone = {k: None for k in ("answer", "group") if getattr(roles, k) and getattr(roles, k) not in columns}
    notes = [f"no column {getattr(roles, k)!r}: no {k} is audited" for k in gone]
    return replace(roles, **gone, labels=tuple(c for c in roles.labels if c in columns)), notes


def guessed(columns: list[str]) -> Roles:
    """Roles by usual names, the first candidate that is there."""
    text = guess_field(columns, TEXT_CANDIDATES)
    if not text:
        raise ValueError("no text column found")
    answer = guess_field(columns, ANSWER_CANDIDATES, (text,))
    return Roles(text, answer, guess_field(columns, GROUP_CANDIDATES, (text, answer or "")))


def as_text(df: DataFrame, column: str) -> Column:
    """A column as text: arrays of strings joined by blanks, structs and maps as JSON, all else as Spark prints it."""
    kind = dict(df.dtypes)[column]
    if kind == "array<string>":
        return F.array_join(F.coalesce(F.col(column), F.array().cast("array<string>")), " ")
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(column), F.lit(""))
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
