"""Chat text from event logs.

A log holds the events of a conversation in sequence: `start` opens a message
with a role and maybe its first text, `delta` appends to a message, `edit`
replaces its text, and `regenerate` takes it back with all that follows. Logs
are dealt by conversation and sorted; one pass folds each into its final
messages and renders them, holding one conversation at a time.

Template: every turn is `<s>`, its role, a line end, its text, `</s>` and a
line end. Within roles and texts a backslash is doubled and the control strings
get one after their first character, so a text can't end or open a turn, and
removing the escapes gives it back.

Null conv_id is a conversation of its own; null turns come first; equal turns
follow a hash of role and text, so equal rows stand together. Null roles and
texts are empty. An empty log gives no rows, empty conversations (in the query)
conversation -1 alone. A conversation of any length is folded whole, in one
task; there is no order across conversations. Columns beside those named are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import sliced
from corpuslens.session import stage

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
ESCAPE = re.compile("|".join(map(re.escape, ("\\", *sorted(CONTROL, key=len, reverse=True)))))
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
OPEN, CLOSE = "<s>", "</s>\n"


def escape(text: str) -> str:
    """Doubles backslashes and breaks control strings up; overlaps included, as every later pass starts inside the first."""
    return ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def rendered(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and the spans of what the assistant said."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The messages of a rendered conversation."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        end = at + len(OPEN)
        while text[end] != "\n":
            end += 2 if text[end] == "\\" else 1
        close = text.index(CLOSE, end)
        out.append((unescape(text[at + len(OPEN) : end]), unescape(text[end + 1 : close])))
        at = close + len(CLOSE)
    return out


class Fold:
    """Final messages of one conversation."""

    def __init__(self):
        self.order: list = []
        self.parts: dict = {}

    def take(self, message, kind: str, role: str | None, text: str | None) -> None:
        if kind == "start":
            self.order.append(message)
            self.parts[message] = (role or "", [text or ""])
        elif message not in self.parts:
            return  # of a message that has been taken back, or that never began
        elif kind == "delta":
            self.parts[message][1].append(text or "")
        elif kind == "edit":
            self.parts[message] = (self.parts[message][0], [text or ""])
        elif kind == "regenerate":
            at = self.order.index(message)
            for x in self.order[at:]:
                del self.parts[x]
            del self.order[at:]
        else:
            raise ValueError(f"event of unknown kind {kind!r}")

    def messages(self) -> list[tuple[str, str]]:
        return [(self.parts[m][0], "".join(self.parts[m][1])) for m in self.order]


def formatted(log: DataFrame, sequence: list[str]) -> DataFrame:
    """(conv_id, formatted, spans) from events (conv_id, message, kind, role, text and the columns of sequence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, fold, done = none, Fold(), []

        def flush(rows: list) -> pa.RecordBatch:
            texts = [(c, *rendered(m)) for c, m in rows]
            spans = pa.array([[{"start": i, "end": j} for i, j in s] for _, _, s in texts], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _, _ in texts], pa.int64()), "formatted": pa.array([t for _, t, _ in texts], pa.string()), "spans": spans})

        for batch in sliced(batches):
            for conv, message, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    if now is not none:
                        done.append((now, fold.messages()))
                    now, fold = conv, Fold()
                fold.take(message, kind, role, text)
            if len(done) >= 256:
                yield flush(done)
                done = []
        if now is not none:
            done.append((now, fold.messages()))
        if done:
            yield flush(done)

    rows = log.repartition("conv_id").sortWithinPartitions("conv_id", *sequence).select(F.col("conv_id").cast("long"), "message", "kind", "role", "text")
    return rows.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, end: long>>")


def log_of(conversations: DataFrame) -> DataFrame:
    """Rows as the events of a chat.

    What the assistant says comes as a draft that is taken back, late deltas of
    the draft included, and then as a stream of two halves. Other messages start
    with half of their text, get an unfinished delta, and are edited into their
    text.
    """
    half, none = F.expr("cast(length(text) div 2 as int)"), F.lit(None).cast("string")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    message = F.col("row").cast("string")
    draft = F.concat(message, F.lit("-draft"))

    def events(*given: tuple) -> Column:
        return F.array(*(F.struct(F.lit(k).alias("step"), m.alias("message"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text")) for k, (m, kind, role, text) in enumerate(given)))

    role = F.col("role")
    again = events((draft, "start", role, rest), (draft, "regenerate", none, none), (draft, "delta", none, first), (message, "start", role, first), (message, "delta", none, rest))
    edited = events((message, "start", role, first), (message, "delta", none, F.lit("...")), (message, "edit", none, F.col("text")))
    return rows.select("conv_id", "turn", "tie", "row", F.inline(F.when(F.col("role") == "assistant", again).otherwise(edited)))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the rendered text and its spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parsed(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                row = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for k, x in zip(out, row):
                    out[k].append(x)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column(0)} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    return chats.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """The digests of all conversations and of conversation -1."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trial = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    chats = formatted(log_of(rows.unionByName(trial)), ["turn", "tie", "row", "step"])
    return digests(stage(chats, "chat"))
