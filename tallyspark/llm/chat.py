"""Chat formatting with typed content parts.

A visitor flattens a message's parts (text, image, audio, document) into one string with ordered
placeholders, and records each attachment's reference, its place and how many tokens its placeholder
expands to. The template marks turns; control strings inside texts and roles are escaped with a
backslash and can be read back exactly. Formatting needs no shuffle; reading back streams the turns of
each conversation in order, so that no conversation is ever held as a whole.

Nulls: a null text or role is empty, null parts give an empty message, parts of unknown kind become a
document placeholder; a null turn comes first; rows with a null conv_id form one conversation of their
own. Repeated rows are turns of their own; turns with the same number go by role, then text. Very long texts are
formatted as a whole, one at a time; a conversation's turns stream through one task, since its digest needs
their order. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

# The template's marks, and the control strings of common chat templates that texts may hold.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>"]

# The first sign of each control string, also where one begins inside another.
_CONTROL = re.compile(f"(?={'|'.join(map(re.escape, CONTROL))})(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_MARK = re.compile(r"<\|(turn|body|end|image:\d+|audio:\d+|document:\d+)\|>")

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = "conv_id long, turn long, role string, piece string, loss array<struct<start:long,length:long>>, attachments array<struct<kind:string,ref:string,position:long,tokens:long>>, expanded_tokens long"


def escape(text: str) -> str:
    """A backslash before each backslash, and after the first sign of each control string."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Visitor:
    """Flattens parts in order. Token counts: an image by patches, audio by frames, a document by pages."""

    def __init__(self, patch: int = 14, frames: float = 25.0, page_tokens: int = 1024):
        self.patch, self.frames, self.page_tokens = patch, frames, page_tokens

    def visit(self, parts: list[dict]) -> tuple[str, list[tuple[int, int]], list[dict], int]:
        """(flattened text, spans of its text parts, attachments, tokens that the placeholders expand to)."""
        out, spans, attached, at = [], [], [], 0
        for part in parts:
            kind = part.get("kind") or "text"
            seen = getattr(self, f"visit_{kind}", self.visit_document)(part, len(attached))
            if isinstance(seen, str):
                spans += [(at, len(seen))] if seen else []
                text = seen
            else:
                text, tokens = seen
                attached.append({"kind": kind, "ref": part.get("ref"), "position": at, "tokens": tokens})
            out.append(text)
            at += len(text)
        return "".join(out), spans, attached, sum(a["tokens"] for a in attached)

    def visit_text(self, part: dict, n: int) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict, n: int) -> tuple[str, int]:
        return f"<|image:{n}|>", ceil((part.get("width") or self.patch) / self.patch) * ceil((part.get("height") or self.patch) / self.patch)

    def visit_audio(self, part: dict, n: int) -> tuple[str, int]:
        return f"<|audio:{n}|>", ceil((part.get("seconds") or 0.0) * self.frames)

    def visit_document(self, part: dict, n: int) -> tuple[str, int]:
        return f"<|document:{n}|>", (part.get("pages") or 1) * self.page_tokens


def format_turns(messages: DataFrame, visitor: Visitor | None = None, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages (conv_id, turn, role, parts) -> FORMATTED, a row for each turn.

    A conversation's formatted text is its pieces in order of turn. loss: spans of the piece, in code
    points, that training is to predict: the texts of the roles in learn_from, without placeholders.
    """
    visitor = visitor or Visitor()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                role = row["role"] or ""
                body, spans, attached, tokens = visitor.visit(row["parts"] or [])
                head = TURN + escape(role) + BODY
                shift = len(head)
                rows.append({"conv_id": row["conv_id"], "turn": row["turn"], "role": role, "piece": head + body + END, "loss": [{"start": s + shift, "length": n} for s, n in spans] if role in learn_from else [], "attachments": [a | {"position": a["position"] + shift} for a in attached], "expanded_tokens": tokens})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    ship(messages.sparkSession)
    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(PARTS)).mapInArrow(run, FORMATTED)


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted text; placeholders stand for nothing."""
    turns, state, role, text, at = [], "", "", "", 0
    for mark in _MARK.finditer(formatted):
        part, kind = formatted[at : mark.start()], mark[1]
        if kind == "body":
            role = unescape(part)
        elif state in ("body", "image", "audio", "document"):
            text += unescape(part)
        if kind == "end":
            turns.append((role, text))
            role = text = ""
        state, at = kind.partition(":")[0], mark.end()
    return turns


def fold_conversations(turns: DataFrame, schema: str, begin: Callable, step: Callable, end: Callable) -> DataFrame:
    """Fold each conversation's turns in order, streaming: state = begin(), step(state, row), row = end(conv_id, state).

    A conversation is in one task, since its digest needs its order, but only the state of one is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    if state is not None:
                        done.append(end(now, state))
                    now, state = row["conv_id"], begin()
                step(state, row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([end(now, state)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted turns, for each conversation."""

    def begin() -> dict:
        return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

    def step(s: dict, row: dict) -> None:
        piece = row["piece"]
        for role, text in read_back(piece):
            s["n"] += 1
            s["turns"].update(f"{role}\n{text}\n".encode())
        for span in row["loss"]:
            learnt = unescape(piece[span["start"] : span["start"] + span["length"]])
            s["loss"].update(learnt.encode())
            s["loss_chars"] += len(learnt)
        s["chars"] += len(piece)

    def end(conv_id: int, s: dict) -> dict:
        return {"conv_id": conv_id, "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["chars"]}

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return fold_conversations(formatted.select("conv_id", "turn", "role", "piece", "loss"), schema, begin, step, end)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    part = F.struct(F.lit("text").alias("kind"), "text", *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return digests(format_turns(rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))))


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for c in sorted(CONTROL, key=len, reverse=True):
        sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
    return sql


ORACLE = f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum({len(TURN + BODY + END)} + length({_escaped("role")}) + length({_escaped("text")})) as bigint) as formatted_chars
from turns group by conv_id
"""
