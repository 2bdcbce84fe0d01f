"""Chat formatting by incremental black-box rendering: spans come from comparing the outputs of turn prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrow import small_batches

#: Turns (role, text) to the formatted text; nothing else is known of a template.
Template = Callable[[list[tuple[str, str]]], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns and characters of a block, which is rendered prefix by prefix; a longer conversation has several.
BLOCK_TURNS, BLOCK_CHARS = 16, 2**20
#: What a later block is rendered behind: the conversation's first turns and the last ones before the block.
LEAD, TRAIL = 1, 2
#: Stands for a text whose place is looked for.
MARK = "\ue000\ue001"

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.S)


def escape(text: str) -> str:
    """text without any `<|`: each gets a backslash inside, one more than it has."""
    return _CONTROL.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def _role_out(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The default template: each turn between marks, control strings inside texts and roles escaped."""
    return "".join(f"{OPEN}{_role_out(r)}\n{escape(t)}{CLOSE}\n" for r, t in turns)


def parse_marked(formatted: str) -> list[tuple[str, str]]:
    """What marked_turns was given; anything else than turns is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((_role_in(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
    return turns


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halves."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def inspect(template: Template) -> tuple[int, list[str]]:
    """What probes tell of a template: characters that always stay behind the last turn, and what it does to earlier turns.

    An end like a generation prompt is found as the least number of last characters that has to move
    for each output to begin with the one before it. Where no number will do, history is rewritten.
    """
    roles = ["system", "user", "assistant", "user", "assistant", "assistant", "user"]
    turns = [(r, f"{chr(0x4E00 + k)} probe {k} {chr(0x5E00 + k)}") for k, r in enumerate(roles)]
    least, findings = 0, []
    for first in (0, 1):
        outs = [template(turns[first : first + k]) for k in range(1, len(turns) - first + 1)]
        for k, (a, b) in enumerate(zip(outs, outs[1:], strict=False), 2):
            p, s = _common(a, b), _common(a[::-1], b[::-1])
            if p + s < len(a):
                findings.append(f"turn {k} ({turns[first + k - 1][0]}) rewrites what stands before it")
            else:
                least = max(least, len(a) - p)
    return (0 if findings else least), findings


def _block(template: Template, before: list[tuple[str, str]], turns: list[tuple[str, str]], tail: int, whole: bool) -> tuple[str, str, list[dict]]:
    """A block behind its context: (its output, the end behind it, a span for each turn).

    Each prefix's output must begin with the one before it, but for the end; a turn where that isn't so
    is marked as rewriting, and turns before it lose their spans, as their texts aren't where they were.
    A text's place is where a mark in its stead comes out, checked on both sides.
    """
    cut = lambda out: len(out) - tail
    out = template(before) if before or not whole else ""
    base = at = 0 if whole else cut(out)
    known, spans = list(before), []
    for role, text in turns:
        marked = template([*known, (role, MARK)])
        known.append((role, text))
        new = template(known)
        span = {"role": role, "start": at - base, "end": cut(new) - base, "text_start": None, "text_end": None, "rewrites": not new.startswith(out[:at])}
        if span["rewrites"]:
            for s in spans:
                s["text_start"] = s["text_end"] = None
            span["start"] = min(_common(out, new), cut(new)) - base
        i = marked.find(MARK, max(0, span["start"] + base))
        rest = len(marked) - i - len(MARK)
        if i >= 0 and len(new) - rest >= i and new.startswith(marked[:i]) and new.endswith(marked[i + len(MARK) :]):
            span["text_start"], span["text_end"] = i - base, len(new) - rest - base
        spans.append(span)
        out, at = new, cut(new)
    return out[base:at], out[at:], spans


SPAN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_()), ("rewrites", pa.bool_())])
_SPANS = "array<struct<turn:bigint,role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean,rewrites:boolean>>"


def format_chats(conversations: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Conversations as formatted texts with each turn's span, in pieces of whole turns.

    conversations: conv_id, turn, role, text; other columns are ignored. Returns conv_id, piece (from 0),
    offset (code points of the conversation before the piece), formatted, spans: turn (from 0), role, start
    and end of all that the turn added, text_start and text_end of its text as it came out, loss (the
    text is to be learned), rewrites (the turn changed what stood before it); offsets within the piece.
    A piece's loss mask is its spans with loss; a text that the template doesn't show in one place has no
    text_start and no loss.

    The template is a black box: it renders a block's prefixes one by one, and consecutive outputs are
    compared. Up to BLOCK_TURNS turns or BLOCK_CHARS characters are a block. A later block of the same
    conversation is rendered behind the first turn and the last two before it, so templates may look
    at those, and not at others; what stays behind the last turn (inspect) is in the last piece.

    Turns are in order of turn (nulls first), then role and text; all rows count, repeated ones too. A
    null text or role is empty; a null conv_id is a conversation of its own; an empty table gives no rows.

    Scale: one shuffle by conversation, sorted, streamed: a task holds a block, however long a
    conversation is. Pieces of a conversation follow each other in the result's partitions.
    """
    small_batches(conversations.sparkSession)
    tail, _ = inspect(template)
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        chars = 0
        conv: object = run  # no id
        lead: list[tuple[str, str]] = []
        trail: list[tuple[str, str]] = []
        block: list[tuple[str, str]] = []
        n_turns = offset = piece = held = 0
        types: pa.Schema | None = None

        def close(last: bool) -> None:
            nonlocal n_turns, offset, piece, held, trail, block, chars
            first = n_turns == 0
            context = [] if first else [*lead, *trail[max(0, LEAD + TRAIL - n_turns) :]]
            text, end, spans = _block(template, context, block, tail, first)
            for k, s in enumerate(spans):
                s |= {"turn": n_turns + k, "loss": s["role"] in loss_roles and s["text_start"] is not None}
            done.append((conv, piece, offset, text + end if last else text, spans))
            if first:
                lead[:] = block[:LEAD]
            n_turns, offset, piece = n_turns + len(block), offset + len(text), piece + 1
            chars += len(text)
            trail, block, held = (trail + block)[-TRAIL:], [], 0

        def out() -> pa.RecordBatch:
            nonlocal done, chars
            columns = list(zip(*done, strict=True))
            done, chars = [], 0
            return pa.RecordBatch.from_arrays([pa.array(columns[0], types.field("conv_id").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.list_(SPAN))], names=["conv_id", "piece", "offset", "formatted", "spans"])

        for b in batches:
            types = b.schema
            for c, role, text in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                if c != conv or conv is run:
                    if block:
                        close(True)
                    conv, lead, trail, n_turns, offset, piece = c, [], [], 0, 0, 0
                elif len(block) >= BLOCK_TURNS or held + len(text) > BLOCK_CHARS:
                    close(False)
                block.append((role, text))
                held += len(text)
                if chars > BLOCK_CHARS:
                    yield out()
        if block:
            close(True)
        if done:
            yield out()

    return rows.mapInArrow(run, f"conv_id {kind}, piece long, offset long, formatted string, spans {_SPANS}")


def read_back(pieces: DataFrame, parse: Callable[[str], list[tuple[str, str]]] = parse_marked, plain: Callable[[str], str] = unescape, ordered: bool = False) -> DataFrame:
    """What the formatted texts say, by conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_rewrites.

    pieces: what format_chats returns; ordered: as it returns them, else they are shuffled and sorted.
    Turns are parsed from the texts (role, \\n, text, \\n each in the digest); the loss is read under the
    spans that have it, unescaped. Digests are chains, so a conversation is read by one task, piece by piece.
    """
    if not ordered:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, types = None, None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = [types.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"])

        for b in batches:
            types = b.schema
            for c, piece, formatted, spans in zip(*[b.column(k).to_pylist() for k in ("conv_id", "piece", "formatted", "spans")], strict=True):
                if piece == 0:
                    if state:
                        done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns = parse(formatted)
                state[0] += len(turns)
                for role, text in turns:
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in spans:
                    if s["loss"]:
                        text = plain(formatted[s["text_start"] : s["text_end"]])
                        state[2] += len(text)
                        state[3].update(text.encode())
                    state[5] += s["rewrites"]
                state[4] += len(formatted)
            if len(done) >= 1000:
                yield out()
        if state:
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
        if done:
            yield out()

    return pieces.select("conv_id", "piece", "formatted", "spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long")
