"""Chat formatting: turns located in the output of a template that is only ever called.

A template is a function from a list of (role, text) turns to one string.  The outputs for
successive prefixes of a conversation are compared: what an output adds to the one before is the
turn's piece.  A turn rendered again with a probe as its text shows what stands before and after
the text, so that the loss mask covers texts and no marker.  Where an output does not begin
with the one before it, the template rewrites history: the turns behind the common start have no
lasting place and are marked.

Rows are dealt by conversation, sorted by turn, and read as a stream.  The first PREFIX turns
are rendered as whole prefixes.  A template may state how many earlier turns (`context`) can change
how a turn looks; if all pieces so far agree with that, later turns are rendered behind that many
turns only, and a conversation of any length takes linear time and the memory of a few turns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Turn = tuple[str, str]

PREFIX = 64
PROBE = "\ue000probe\ue001"
ASSISTANT = "assistant"

#: Fixed values of the template: what stands before and after a text, by role.
MARKS = {"system": ("[SYS] ", " [/SYS]\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": ("[OUT] ", " [/OUT]</s>\n")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]\n")
CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=(?:/?(?:INST|OUT|SYS|ROLE)|TEXT)\])")


def escape(text: str) -> str:
    """A backslash after each backslash and after the first character of each control string."""
    return CONTROL.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    """Double backslashes become one, single ones go."""
    return re.sub(r"\\(\\?)", r"\1", text)


def instruction(turns: list[Turn]) -> str:
    """The built-in template; any role, any order."""
    out = []
    for role, text in turns:
        before, after = MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
        out.append(before + escape(text) + after)
    return "".join(out)


PIECE = re.compile("|".join(f"{re.escape(b)}(?P<{r}>.*?){re.escape(a)}" for r, (b, a) in MARKS.items()) + f"|{re.escape(OTHER[0])}(?P<role>.*?){re.escape(OTHER[1])}(?P<text>.*?){re.escape(OTHER[2])}", re.S)


def parse_instruction(formatted: str) -> list[Turn]:
    """The turns of an output of `instruction`; escaped texts hold no mark, so the first end is the end."""
    turns = []
    at = 0
    while at < len(formatted):
        m = PIECE.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["text"])) if kind == "text" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


@dataclass(frozen=True)
class Template:
    """render: the black box.  context: how many earlier turns can change a turn's look (None: unknown)."""

    render: Callable[[list[Turn]], str]
    context: int | None = None


INSTRUCTION = Template(instruction, context=0)


def body_span(render: Callable[[list[Turn]], str], turns: list[Turn], before: str, piece: str) -> tuple[int, int] | None:
    """Where the last turn's text stands in its piece; None where the probe does not show it."""
    probed = render([*turns[:-1], (turns[-1][0], PROBE)])
    if not probed.startswith(before):
        return None
    probed = probed[len(before) :]
    at = probed.find(PROBE)
    if at < 0 or probed.find(PROBE, at + 1) >= 0:
        return None
    head, tail = probed[:at], probed[at + len(PROBE) :]
    if len(piece) < len(head) + len(tail) or not piece.startswith(head) or not piece.endswith(tail):
        return None
    return len(head), len(piece) - len(tail)


@dataclass
class Piece:
    """A turn's part of the output: where it starts, and its text's span inside the piece."""

    role: str
    text: str
    start: int
    body: tuple[int, int] | None
    rewritten: bool = False


def locate(turns: Iterator[Turn], template: Template, prefix: int = PREFIX) -> Iterator[Piece]:
    """The pieces of one conversation, in order.

    A piece whose output is no longer the start of a later one is `rewritten`; its place is that in
    the output of its own prefix.  While a rewrite can still be seen (within the first `prefix`
    turns, or for ever if the context is unknown or wrong) pieces are held back.
    """
    render, context = template.render, template.context
    seen: list[Turn] = []
    held: list[Piece] = []
    last, local = "", context is not None
    recent: deque[Turn] = deque(maxlen=(context or 0) + 1)
    at = 0
    for n, turn in enumerate(turns):
        recent.append(turn)
        if local and n >= prefix:
            if held:
                yield from held
                held, seen = [], []
            window = list(recent)
            before, whole = render(window[:-1]), render(window)
            ok = whole.startswith(before)
            piece = whole[len(before) :] if ok else whole
            yield Piece(turn[0], piece, at, body_span(render, window, before, piece) if ok else None, not ok)
            at += len(piece)
            continue
        seen.append(turn)
        out = render(seen)
        if out.startswith(last):
            piece = out[len(last) :]
            held.append(Piece(turn[0], piece, len(last), body_span(render, seen, last, piece)))
        else:
            kept = len(os.path.commonprefix([last, out]))
            for p in held:
                p.rewritten |= p.start + len(p.text) > kept
            held.append(Piece(turn[0], out[kept:], kept, None))
            local = False
        if local:
            window = list(recent)
            alone, behind = render(window), render(window[:-1])
            local = alone.startswith(behind) and alone[len(behind) :] == held[-1].text
        last, at = out, len(out)
    yield from held


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[Turn]]]:
    """(id, its turns) of rows sorted by id; null roles and texts are empty."""
    import itertools

    def rows():
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                yield from zip(*(c.to_pylist() for c in part.columns))

    for key, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield key, ((r[1] or "", r[2] or "") for r in group)


def _sorted(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(
        F.col(id_col).alias("id"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), F.col(turn_col).alias("turn")
    )
    return rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").drop("turn")


def _emit(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 256 rows or about a million characters."""
    part, chars = [], 0
    for r in rows:
        part.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(part) == 256 or chars > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, chars = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def format_turns(
    conversations: DataFrame, template: Template = INSTRUCTION, prefix: int = PREFIX,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """id_col, position, role, piece, start, body_start, body_end, in_loss, rewritten per turn.

    Pieces in order of position are the formatted conversation, if no turn is rewritten.  start is the
    piece's place in it; body_start and body_end the text's place in the piece (null where the
    template does not show it).  in_loss marks assistant turns whose text is in the loss.
    Turns are ordered by turn (null first), role and text; rows that repeat are turns of their
    own.  Null texts and roles are empty, a null id is a conversation.  Other columns are ignored.
    """
    kind = conversations.schema[id_col].dataType
    ddl = f"id {kind.simpleString()}, position bigint, role string, piece string, start bigint, body_start bigint, body_end bigint, in_loss boolean, rewritten boolean"
    schema = pa.schema(
        [("id", to_arrow_type(kind)), ("position", pa.int64()), ("role", pa.string()), ("piece", pa.string())]
        + [(c, pa.int64()) for c in ("start", "body_start", "body_end")] + [(c, pa.bool_()) for c in ("in_loss", "rewritten")]
    )

    def run(batches):
        def rows():
            for key, turns in _conversations(batches):
                for k, p in enumerate(locate(turns, template, prefix)):
                    low, high = p.body or (None, None)
                    yield key, k, p.role, p.text, p.start, low, high, p.role == ASSISTANT and p.body is not None and not p.rewritten, p.rewritten

        yield from _emit(schema, rows())

    return _sorted(conversations, id_col, turn_col, role_col, text_col).mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def digests(
    conversations: DataFrame, template: Template = INSTRUCTION, parse: Callable[[str], list[Turn]] = parse_instruction,
    unescaped: Callable[[str], str] = unescape, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars per conversation.

    All of it is read back from the formatted output: roles and texts by parsing the pieces, the loss
    from the masked spans.  Nulls, ties and repeated rows as in format_turns.
    """
    kind = conversations.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def rows():
            for key, turns in _conversations(batches):
                all_turns, loss = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = 0
                for p in locate(turns, template):
                    for role, text in parse(p.text):
                        all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        n += 1
                    if p.role == ASSISTANT and p.body and not p.rewritten:
                        said = unescaped(p.text[slice(*p.body)])
                        loss.update(said.encode("utf-8", "surrogatepass"))
                        loss_chars += len(said)
                    chars += len(p.text)
                yield key, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _emit(schema, rows())

    ddl = f"id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return _sorted(conversations, id_col, turn_col, role_col, text_col).mapInArrow(run, ddl).withColumnRenamed("id", id_col)
