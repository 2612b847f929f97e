r"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio or document. ``Flattener`` visits them in order: text is
escaped, every other part becomes a placeholder mark, an attachment record (kind, number in the
conversation, reference, place in the output, tokens that the placeholder expands to). Marks of the
template around the turns are control strings, and so are the placeholders. A text that holds a
control string gets a backslash behind the first character of it; one that already has backslashes
there gets one more. So no control string is left in a text, reading drops one backslash again, and
all other texts stay as they are. Control strings begin with ``<`` or ``[``, end with ``>`` or ``]`` and
hold these nowhere else, so none can arise where a text meets a mark.

Conversations are dealt by ranges of (conversation, turn), each task writes the turns of its range in
order, and a conversation of any length leaves as numbered segments of bounded size, cut between
turns: a hot conversation is spread over tasks and never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.llm import words as W
from vetgrid.session import stage_table

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "struct<kind: string, number: int, ref: string, at: long, tokens: long>"
SPAN = "struct<start: long, length: long>"
SEGMENT = f"conv_id long, part long, whole boolean, n_turns long, text string, loss array<{SPAN}>, " \
          f"attachments array<{ATTACHMENT}>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
SEGMENT_CHARS = 1 << 20  # a segment ends with the turn that reaches it

# Fixed values of the template: marks before and behind a turn of each role, and placeholders.
ROLES = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ASSISTANT] ", "</s>")}
OTHER = ("[ROLE]", "[BODY]", "[/ROLE]")
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
LEARNED = "assistant"
CONTROLS = sorted({m.strip() for pair in ROLES.values() for m in pair} | set(OTHER) | set(PLACEHOLDERS.values())
                  | {"<s>"})

_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_RESTS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_RESTS})")
_TURN = re.compile("|".join(
    [re.escape(a) + f"(?P<{role}>.*?)" + re.escape(b) for role, (a, b) in ROLES.items()]
    + [re.escape(OTHER[0]) + "(?P<name>.*?)" + re.escape(OTHER[1]) + "(?P<other>.*?)" + re.escape(OTHER[2])]), re.S)
_PLACEHOLDER = re.compile("(" + "|".join(map(re.escape, PLACEHOLDERS.values())) + ")")
_KINDS = {mark: kind for kind, mark in PLACEHOLDERS.items()}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@dataclass(frozen=True)
class Costs:
    """Tokens that a placeholder expands to: an image by patches, audio by time, a document by pages."""

    patch: int = 14
    largest: int = 1540  # longer sides are scaled down to it
    audio_rate: float = 12.5
    page: int = 256

    def image(self, width: int | None, height: int | None) -> int:
        width, height = max(width or 1, 1), max(height or 1, 1)
        scale = max(width, height, self.largest) / self.largest
        across, down = (max(1, -(-int(side / scale) // self.patch)) for side in (width, height))
        return down * (across + 1)  # one more token ends each row of patches

    def audio(self, seconds: float | None) -> int:
        return max(1, -int(-(seconds or 0.0) * self.audio_rate // 1))

    def document(self, pages: int | None) -> int:
        return max(pages or 1, 1) * self.page


class Flattener:
    """Visitor that writes turns, records attachments and marks what is learned; one for each segment.

    Neighbouring text parts are one text, so that no control string arises between them."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.pieces: list[str] = []
        self.pending: list[str] = []
        self.chars = self.turns = 0
        self.attachments: list[dict] = []
        self.loss: list[dict] = []

    def turn(self, role: str | None, parts: list[dict] | None) -> None:
        role = role or ""
        before, behind = ROLES.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
        self.write(before)
        for part in parts or ():
            if part is not None:
                self.visit(part, role == LEARNED)
        self.flush(role == LEARNED)
        self.write(behind)
        self.turns += 1

    def visit(self, part: dict, learned: bool) -> None:
        kind = part["kind"] or "text"
        if kind != "text":
            self.flush(learned)
        getattr(self, f"visit_{kind}", self.unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.pending.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, self.costs.image(part["width"], part["height"]))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, self.costs.audio(part["seconds"]))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, self.costs.document(part["pages"]))

    def unknown(self, part: dict) -> None:
        raise ValueError(f"unknown kind of content part: {part['kind']}")

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "number": len(self.attachments), "ref": part["ref"],
                                 "at": self.chars, "tokens": tokens})
        self.write(PLACEHOLDERS[kind])

    def flush(self, learned: bool) -> None:
        text = escape("".join(self.pending))
        self.pending.clear()
        if learned and text:
            self.loss.append({"start": self.chars, "length": len(text)})
        self.write(text)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.chars += len(text)

    def segment(self, conv_id: int | None, part: int, whole: bool) -> tuple:
        return conv_id, part, whole, self.turns, "".join(self.pieces), self.loss, self.attachments


def text_parts(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, parts)`` of a table with plain ``text``: one text part for each row."""
    part = F.named_struct(
        F.lit("kind"), F.lit("text"), F.lit("text"), F.col("text"), F.lit("ref"), F.lit(None).cast("string"),
        F.lit("width"), F.lit(None).cast("int"), F.lit("height"), F.lit(None).cast("int"),
        F.lit("seconds"), F.lit(None).cast("double"), F.lit("pages"), F.lit(None).cast("int"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def formatted(turns: DataFrame, *, costs: Costs = Costs(), segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments ``(conv_id, part, whole, n_turns, text, loss, attachments)`` of formatted conversations.

    ``turns (conv_id, turn, role, parts)`` with ``parts array<PART>``; further columns are ignored. The
    text of a conversation is that of its segments in the order of ``part``; one with ``whole`` has no
    other. ``loss`` holds the spans of assistant text in the segment, in code points of ``text``.

    Turns go by ``turn`` (null first), ties by role and a hash of the parts; repeated rows are turns
    of their own. A null role reads back as the empty one, null parts, texts and lists as empty, turns
    without a ``conv_id`` are one conversation. An unknown kind of part ends the job. Texts of any
    length are written whole, and an empty table gives no rows.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "parts",
                         F.xxhash64("role", "parts").alias("tie"))
    order = ("conv_id", "turn", "role", "tie")
    dealt = turns.repartitionByRange("conv_id", "turn", "tie").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # ranges are numbered in order
        begun, current, open_, alone = False, None, Flattener(costs), False
        for batch in batches:
            closed = []
            for conv_id, role, parts in W.rows([batch], "conv_id", "role", "parts"):
                if begun and conv_id != current:
                    closed.append(open_.segment(current, number, alone))
                    open_, number, alone = Flattener(costs), number + 1, True
                elif begun and open_.chars >= segment_chars:
                    closed.append(open_.segment(current, number, False))
                    open_, number, alone = Flattener(costs), number + 1, False
                begun, current = True, conv_id
                open_.turn(role, parts)
            yield _segments(closed)
        if begun:  # the first and the last conversation of a range may go on in another one
            yield _segments([open_.segment(current, number, False)])

    return dealt.select("conv_id", "role", "parts").mapInArrow(write, SEGMENT)


_SEGMENT_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([
        ("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])))])


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in _SEGMENT_ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, _SEGMENT_ARROW)], schema=_SEGMENT_ARROW)


def read_turns(text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """``(role, parts)`` of a segment: each part is ``("text", text)`` or ``(kind, "")``."""
    at = 0
    for match in _TURN.finditer(text):
        if match.start() != at:
            break
        at = match.end()
        kind = match.lastgroup
        role = unescape(match["name"]) if kind == "other" else kind
        pieces = _PLACEHOLDER.split(match[kind])
        yield role, [(_KINDS[p], "") if i % 2 else ("text", unescape(p)) for i, p in enumerate(pieces) if p]
    if at != len(text):
        raise ValueError(f"no turn begins at character {at}")


class Digest:
    """What a formatted conversation reads back as, segment after segment."""

    def __init__(self):
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, loss: list[dict]) -> None:
        for role, parts in read_turns(text):
            said = "".join(t for kind, t in parts if kind == "text")
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for span in loss:
            said = unescape(text[span["start"] : span["start"] + span["length"]])
            self.learned.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars


_DIGEST_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(segments: DataFrame) -> DataFrame:
    """One row of counts and SHA-256 digests for each conversation, read back from its segments.

    A conversation in one segment is digested where it stands. Only the rest is shuffled, and read in
    order of its segments, so that no conversation is held whole (a digest has no other order)."""
    names = _DIGEST_ARROW.names

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, part, alone, text, loss in W.rows([batch], "conv_id", "part", "whole", "text", "loss"):
                if alone:
                    digest = Digest()
                    digest.add(text, loss)
                    rows.append((conv_id, *digest.row(), None, None, None))
                else:
                    rows.append((conv_id, *[None] * 5, part, text, loss))
            columns = list(zip(*rows)) or [[] for _ in range(9)]
            types = [*_DIGEST_ARROW.types, pa.int64(), pa.string(), _SEGMENT_ARROW.field("loss").type]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], [*names, "part", "text", "loss"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = W.rows(batches, "conv_id", "text", "loss")
        for conv_id, group in groupby(rows, lambda r: r[0]):
            digest = Digest()
            for _, text, loss in group:
                digest.add(text, loss)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((conv_id, *digest.row()), _DIGEST_ARROW.types)], names)

    step = stage_table(segments.mapInArrow(whole, f"{DIGEST}, part long, text string, loss array<{SPAN}>"), "chat-digests")
    rest = step.filter("part is not null").select("conv_id", "part", "text", "loss").repartition(
        "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(joined, DIGEST)
    return step.filter("part is null").select(*names).unionByName(rest)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(formatted(text_parts(turns.unionByName(control))))
