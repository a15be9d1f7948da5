"""Chat formatting of conversations with typed content parts.

A turn's content is an ordered list of parts: text, image, audio or document.  A visitor
flattens them: text is written with control strings escaped, every other part becomes a
placeholder; its reference, its place and the tokens that it expands to are recorded.  One
row per turn stays one row, so a conversation of any length needs no large row and no group.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts a backslash is doubled, and a
``<`` before ``|`` or at the end of a part becomes ``\\l``; so ``<|`` only occurs in marks,
and texts can be read back exactly.  In roles a line break becomes ``\\n``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
# Tokens that one unit (image tile, second of audio, page of a document) expands to.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
LOSS_ROLE = "assistant"

PART = "struct<kind:string,text:string,ref:string,units:int>"


def text_part(text: Column) -> Column:
    """A content list of one text part; a null text is an empty one."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=\||\z)", r"\\l")


def _visit(part: Column, number: Column) -> Column:
    """What a part is written as, and what it attaches."""
    kind = part["kind"]
    per_unit = F.lit(0)
    for name, tokens in UNIT_TOKENS.items():
        per_unit = F.when(kind == name, tokens).otherwise(per_unit)
    is_text = (kind == "text") | kind.isNull()
    mark = F.concat(F.lit("<|"), F.coalesce(kind, F.lit("")), F.lit(":"), number.cast("string"), F.lit("|>"))
    return F.struct(
        F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark).alias("written"),
        is_text.alias("is_text"), kind.alias("kind"), part["ref"].alias("ref"),
        F.when(is_text, 0).otherwise(per_unit * F.coalesce(part["units"], F.lit(1))).alias("tokens"))


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 content_col: str = "content", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end, attachments, expanded_tokens) per turn.

    ``loss_start`` and ``loss_end`` bound the characters of ``formatted`` under the loss mask:
    the content of turns of ``loss_role``; elsewhere both are 0.  ``attachments`` lists, in
    order, kind, reference, character offset in ``formatted`` and expanded tokens.

    A null content list or text is empty, a null role an empty one; a null kind is text.
    A kind without ``UNIT_TOKENS`` becomes a placeholder of 0 tokens.  Repeated rows stay
    turns of their own.  No rows give no rows.  Other columns aren't read.
    """
    parts = F.coalesce(F.col(content_col), F.array().cast(f"array<{PART}>"))
    role = F.replace(escape(F.coalesce(F.col(role_col), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"),
        head.alias("head"), F.explode(F.array(F.transform(parts, _visit))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["written"]), "")
    rows = rows.withColumn("body", F.explode(F.array(body)))

    def placed(p: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(F.col("parts"), F.lit(1), i), F.length("head"), lambda n, q: n + F.length(q["written"]))
        return F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), before.alias("offset"), p["tokens"].alias("tokens"), p["is_text"].alias("is_text"))

    attached = F.transform(F.filter(F.transform("parts", placed), lambda a: ~a["is_text"]), lambda a: a.dropFields("is_text"))
    loss = F.coalesce(F.col("role") == loss_role, F.lit(False))
    return rows.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(END + "\n")).alias("formatted"),
        F.when(loss, F.length("head")).otherwise(0).alias("loss_start"),
        F.when(loss, F.length("head") + F.length("body")).otherwise(0).alias("loss_end"),
        attached.alias("attachments"),
        F.aggregate("parts", F.lit(0), lambda n, p: n + p["tokens"]).alias("expanded_tokens"))


_ESCAPED = re.compile(r"\\([\\ln])")
_PLAIN = {"\\": "\\", "l": "<", "n": "\n"}


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and content text of one formatted turn; placeholders stay as they are."""
    if not (formatted.startswith(START) and formatted.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, body = formatted[len(START):-len(END) - 1].partition("\n")
    if START in body or END in body:
        raise ValueError("a mark inside a text")
    return unescape(role), unescape(body)


class _Reading:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        role, text = read_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{text}\n".encode())
        masked = unescape(formatted[start:end])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted turns of each conversation hold, read back turn by turn.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).  Turns come in
    the order of turn, role and text (nulls first).  Rows of a conversation are sorted into one
    partition but pass through it one by one, so its length isn't bounded by memory.  Turns
    with a null ``conv_id`` form one conversation.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        for batch in batches:
            done = []
            columns = (batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
            for conv_id, text, start, end in zip(*columns, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Reading(conv_id)
                now.add(text, start, end)
            if done:
                yield _rows(done)
        if now is not None:
            yield _rows([now.row()])

    kept = formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end")
    ordered = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
