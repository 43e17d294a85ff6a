"""Chat formatting: a state machine over roles, and text segments with loss flags from a declared template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "<start>"


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles may follow which, and whose text counts for the loss.

    `heads` mark the known roles; any other role, null included, is written with `other_head`, its
    quoted name and `other_end`, and breaks the order. `follows` is the state machine: the state is
    the last role. `ends` are the roles that a whole conversation may end with. Control strings
    inside texts get `escape` before them, and an escape character is doubled, so every text can be
    read back.
    """

    heads: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ",
    })
    other_head: str = "### Role ["
    other_end: str = "]: "
    tail: str = "</turn>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        START: frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"}),
    })
    ends: frozenset[str] = frozenset({"assistant"})
    escape: str = "\\"

    @cached_property
    def controls(self) -> re.Pattern:
        """The escape character and every control string, without the white space around it."""
        marks = [m.strip() for m in (*self.heads.values(), self.other_head, self.other_end, self.tail)]
        marks = sorted({m for m in marks if m}, key=len, reverse=True)
        return re.compile("|".join(map(re.escape, [self.escape, *marks])))

    def escaped(self, text: str) -> str:
        return self.controls.sub(lambda m: self.escape + m.group(), text)

    @cached_property
    def _unescape(self) -> re.Pattern:
        return re.compile(re.escape(self.escape) + "(.)", re.S)

    def unescaped(self, text: str) -> str:
        return self._unescape.sub(r"\1", text)

    def segments(self, role: str | None, text: str) -> list[tuple[str, bool]]:
        head = self.heads.get(role or "")
        if head is None:
            head = self.other_head + self.escaped(role or "") + self.other_end
        return [(head, False), (self.escaped(text), role in self.loss), (self.tail, False)]

    def until(self, text: str, at: int, mark: str) -> int:
        """Where the first unescaped `mark` at or after `at` begins."""
        while True:
            found, slash = text.index(mark, at), text.find(self.escape, at)
            if slash < 0 or slash > found:
                return found
            at = slash + len(self.escape) + 1

    def parse(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn of a formatted conversation."""
        at = 0
        while at < len(text):
            for role, head in self.heads.items():
                if text.startswith(head, at):
                    at += len(head)
                    break
            else:
                if not text.startswith(self.other_head, at):
                    raise ValueError(f"no turn begins at {at}")
                at += len(self.other_head)
                end = self.until(text, at, self.other_end)
                role, at = self.unescaped(text[at:end]), end + len(self.other_end)
            end = self.until(text, at, self.tail)
            yield role, self.unescaped(text[at:end])
            at = end + len(self.tail)


SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(
    df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per turn (conv_id, turn, role, problem, segments), whole conversations in order of turn.

    `problem` is null where the role may follow the one before. Rows are dealt by conversation and
    sorted, then read as a stream that remembers one role, so a conversation of any length takes
    bounded memory; sorting spills. Null text counts as empty, a null turn comes first, ties are
    ordered by role and text, repeated rows are turns like others, rows without a conversation id
    form one conversation, an empty table gives no rows. Further columns are not carried.
    """
    template = template or Template()
    rows = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, problem string, segments array<struct<text:string,loss:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = object(), START
        for batch in batches:
            convs, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            problems, segments = [], []
            for c, r, t in zip(convs, roles, texts, strict=True):
                if c != here:
                    here, state = c, START
                allowed = template.follows.get(state, frozenset())
                problems.append(None if r in allowed else f"{r or ''} after {state}")
                segments.append([{"text": s, "loss": flag} for s, flag in template.segments(r, t)])
                state = r or ""
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2).cast(pa.string()), pa.array(problems, pa.string()),
                 pa.array(segments, SEGMENTS)],
                names=["conv_id", "turn", "role", "problem", "segments"],
            )

    return ordered.mapInArrow(run, schema)


def read_back(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, from the formatted segments alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, problem). Takes
    `format_turns` output as it is, dealt and sorted. Digests are updated turn by turn, so memory does
    not grow with a conversation. `valid`: no turn breaks the order and the last role may end it.
    """
    template = template or Template()
    kind = dict(turns.dtypes)["conv_id"]
    schema = (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, valid boolean, problem string"
    )

    class Digest:
        def __init__(self, conv) -> None:
            self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()
            self.problem, self.last = None, ""

        def add(self, problem, segments) -> None:
            formatted = "".join(s["text"] for s in segments)
            self.chars += len(formatted)
            for role, text in template.parse(formatted):
                self.turns += 1
                self.last = role
                self.all.update(f"{role}\n{text}\n".encode())
            for s in segments:
                if s["loss"]:
                    plain = template.unescaped(s["text"])
                    self.loss_chars += len(plain)
                    self.loss.update(plain.encode())
            self.problem = self.problem or problem

        def row(self) -> tuple:
            problem = self.problem or (None if self.last in template.ends else f"ends with {self.last}")
            return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                    problem is None, problem)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            done = []
            for c, p, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now.conv != c:
                    if now:
                        done.append(now.row())
                    now = Digest(c)
                now.add(p, s)
            yield batch_of(done)
        if now:
            yield batch_of([now.row()])

    return turns.select("conv_id", "problem", "segments").mapInArrow(run, schema)
