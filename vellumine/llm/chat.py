"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: messages opened, streamed deltas, edits and regenerations.
It is partitioned by conversation, sorted by sequence, and folded into final messages, which a
template renders. The fold streams: one conversation's messages are held at a time.

Events (columns conv, seq, kind, slot, role, text; extra columns are ignored):

- ``open``: slot starts as a message of ``role`` with ``text``; a slot that is there keeps its place;
- ``delta``: ``text`` is added to the slot's current text;
- ``edit``: the slot's text is replaced;
- ``regenerate``: the slot's text is emptied and later slots are dropped; deltas follow.

Template: each turn is ``<|turn|>role<|text|>text<|end|>``, and a conversation is its turns. Texts
and roles are escaped: a backslash doubles, and ``<|`` becomes ``<\\|``, so no control string can
stand in a text, and unescaping gives the text back exactly.

Edge cases: null texts and roles are empty; ties in sequence follow slot, kind, role and text, so
reruns agree; repeated turn rows are turns of their own; a null conversation id is one
conversation; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Code points of a streamed delta, and of a first draft, in the log that is made of a table of turns.
DELTA, DRAFT = 256, 32


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(messages: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(r)}{TEXT}{escape(t)}{END}" for r, t in messages)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in re.findall(r"<\|turn\|>((?:(?!<\|).)*)<\|text\|>((?:(?!<\|).)*)<\|end\|>", formatted, re.S)]


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Code-point spans of a rendered conversation that the loss counts: escaped texts of ``role``."""
    return [m.span(2) for m in re.finditer(r"<\|turn\|>((?:(?!<\|).)*)<\|text\|>((?:(?!<\|).)*)<\|end\|>", formatted, re.S) if unescape(m[1]) == role]


def fold(events) -> list[tuple[str, str]]:
    """Final messages of one conversation's events (seq order): (kind, slot, role, text)."""
    slots: dict = {}
    for kind, slot, role, text in events:
        if kind == "open":
            slots[slot] = [role, [text]]
        elif kind == "delta":
            slots.setdefault(slot, [role, []])[1].append(text)
        elif kind == "edit":
            slots.setdefault(slot, [role, []])[1] = [text]
        elif kind == "regenerate":
            slots.setdefault(slot, [role, []])[1] = []
            for later in [s for s in slots if s > slot]:
                del slots[later]
    return [(slots[s][0], "".join(slots[s][1])) for s in sorted(slots)]


def reconstruct(events: DataFrame) -> DataFrame:
    """conv, formatted, n_turns: each conversation of an event log, folded and rendered.

    One shuffle by conversation and a sort within partitions; folding streams over the batches,
    so memory is bounded by one conversation's messages.
    """
    log = events.select("conv", "seq", "kind", "slot", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = log.repartition("conv").sortWithinPartitions("conv", "seq", "slot", F.col("kind").desc(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at, started = None, False
        out: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                c, f, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(f, pa.string()), pa.array(n, pa.int64())], names=["conv", "formatted", "n_turns"])
                out = []

        def close() -> None:
            messages = fold(held)
            out.append((at, render(messages), len(messages)))

        for b in batches:
            for conv, *event in zip(*(b.column(c).to_pylist() for c in ("conv", "kind", "slot", "role", "text")), strict=True):
                if started and conv != at:
                    close()
                    held = []
                    if len(out) >= 500:
                        yield from flush()
                at, started = conv, True
                held.append(event)
        if started:
            close()
        yield from flush()

    return ordered.mapInArrow(run, "conv long, formatted string, n_turns long")


def turn_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = DELTA) -> DataFrame:
    """The log that a table of turns stands for: a draft of each turn is opened and replaced by an edit or, where the
    role is assistant, regenerated; then its text is streamed in deltas.

    Turns go by their number, null first; rows of one number are turns of their own, in the order of role and text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # ranks keep repeated rows apart; a partition is one turn of one conversation
    place = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text"))
    named = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), t.alias("text"))
    placed = named.withColumn("place", place)
    event = lambda kind, part, own: F.struct(F.lit(kind).alias("kind"), F.lit(part).alias("part"), own.alias("text"))
    drafted = F.array(event("open", -2, F.substring("text", 1, DRAFT)), F.when(F.col("role") == "assistant", event("regenerate", -1, F.lit(""))).otherwise(event("edit", -1, F.lit(""))))
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(1), F.length("text"), F.lit(size))).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(starts, lambda i: F.struct(F.lit("delta").alias("kind"), i.alias("part"), F.col("text").substr(i, F.lit(size)).alias("text")))
    # slots sort as text: null turns, then the turn moved above zero, then the place among its repeated rows
    above = (F.col("turn").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string")
    number = F.concat(F.coalesce(F.concat(F.lit("1"), F.lpad(above, 20, "0")), F.lit("0")), F.lit("."), F.lpad(F.col("place").cast("string"), 12, "0"))
    return placed.select("conv", "role", "turn", "place", number.alias("slot"), F.explode(F.concat(drafted, deltas)).alias("e")).select(
        "conv", F.struct("turn", "place", F.col("e.part")).alias("seq"), "e.kind", "slot", "role", "e.text")


def digests(formatted: pd.Series) -> pd.DataFrame:
    """What is read back from rendered conversations."""
    rows = []
    for f in formatted:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = 0
        for role, text in parse(f):
            n += 1
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for s, e in loss_spans(f):
            own = unescape(f[s:e])
            chars += len(own)
            loss.update(own.encode("utf-8", "surrogatepass"))
        rows.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(f)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op6(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, rendered, and the digests read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rendered = reconstruct(turn_events(table.unionByName(more)))
    read_back = F.pandas_udf(digests, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return rendered.select(F.col("conv").alias("conv_id"), read_back("formatted").alias("d"), "formatted").select("conv_id", "d.*", "formatted")


def sql(table: str = "conversations") -> str:
    """DuckDB SQL for op6: the template and its digests by aggregates."""
    escaped = lambda c: f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table}
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), shown AS (
  SELECT *, '{TURN}' || {escaped('role')} || '{TEXT}' || {escaped('text')} || '{END}' AS part FROM rows
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, string_agg(part, '' ORDER BY turn NULLS FIRST, role, text) AS formatted
  FROM shown GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, length(formatted) AS formatted_chars, formatted FROM whole
"""
