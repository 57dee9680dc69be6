r"""Chat formatting with a grammar that reads its own output back.

A conversation is rendered as turns `### Role: text </turn>\n`; a parser with one rule a token gives the turns back. Each turn is
rendered, parsed and compared with its source: first as it is, then with the control strings in it escaped, then with every
backslash, `#` and `<` escaped, until what is parsed is identical. The escape sign is a backslash and only means something
before `\`, `#` or `<`, so most texts are rendered as they are.

Output rows are segments of a conversation, of about SEGMENT characters at most plus one turn (conv_id, segment, formatted, spans):
spans are the (start, end) of the assistant's escaped texts in the segment, which are the loss mask. Conversations are sorted by
(conv_id, turn) and streamed: no conversation is held whole, however long.

Edge cases: a null text or role is empty; a null turn comes first; turns that tie are ordered by role and text; a null
conv_id is one conversation; repeated rows are repeated turns; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, written

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
LEARN = "Assistant"
SEGMENT = 1 << 20

CONTROL = re.compile(r"\\(?=[\\#<])|###|</turn>")
EVERY = re.compile(r"[\\#<]")
ESCAPED = re.compile(r"\\([\\#<])")
#: One turn: a header, the text up to the first unescaped end mark.
TURN = re.compile(r"### ((?:\\[\\#<]|[^\n:\\#]|\\(?![\\#<]))*): ((?:\\[\\#<]|(?!</turn>|###)[\s\S])*?) </turn>\n")
LEVELS = (lambda s: s, lambda s: CONTROL.sub(lambda m: "\\" + m[0], s), lambda s: EVERY.sub(lambda m: "\\" + m[0], s))
#: A role's colon, line break or sign would end the header: they are written as \#xHH; .
ROLE_SIGN, ROLE_CODE = re.compile(r"[:\n\\#<]"), re.compile(r"\\#x([0-9a-f]+);")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def write_role(role: str) -> str:
    plain = ROLE_SIGN.sub(lambda m: f"\\#x{ord(m[0]):x};", role)
    return plain[:1].upper() + plain[1:] if role[:1].islower() and role[:1].upper().lower() == role[:1] and len(role[:1].upper()) == 1 else "\\#x;" + plain


def read_role(name: str) -> str:
    if name.startswith("\\#x;"):
        return ROLE_CODE.sub(lambda m: chr(int(m[1], 16)), name[4:])
    return ROLE_CODE.sub(lambda m: chr(int(m[1], 16)), name[:1].lower() + name[1:])


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of every turn; start and end are the escaped text's place. None if it isn't of the grammar."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            return None
        out.append((read_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text lies in it; the first level at which the parser gives the source back."""
    head = OPEN + write_role(role) + MIDDLE
    for level in LEVELS:
        body = level(text)
        turn = head + body + CLOSE
        got = parse(turn)
        if got and len(got) == 1 and got[0][:2] == (role, text):
            return turn, len(head), len(head) + len(body)
    raise ValueError(f"no escape level gives this turn back: {role!r} {text[:200]!r}")


def format_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, formatted, spans) of every conversation."""

    def run(batches):
        names = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        now, started, k, parts, n, spans, rows, held = None, False, 0, [], 0, [], [], 0

        def flush():
            rows.append({"conv_id": now, "segment": k, "formatted": "".join(parts), "spans": spans})

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                role, text = role or "", text or ""
                if started and conv != now:
                    flush()
                    held += n
                    k, parts, n, spans = 0, [], 0, []
                elif started and n >= segment:
                    flush()
                    held += n
                    k, parts, n, spans = k + 1, [], 0, []
                now, started = conv, True
                turn, a, b = render(role, text)
                if role == LEARN.lower():
                    spans.append({"start": n + a, "end": n + b})
                parts.append(turn)
                n += len(turn)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=names)
                    rows, held = [], 0
        if started:
            flush()
        yield pa.RecordBatch.from_pylist(rows, schema=names)

    text_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, segment int, formatted string, spans array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """A row a conversation, from the formatted segments alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, started, state, rows = None, False, None, []

        def result():
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv != now:
                    if started:
                        rows.append(result())
                    now, started, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                if turns is None:
                    raise ValueError(f"conversation {conv} isn't of the grammar")
                state[0] += len(turns)
                for role, said, _, _ in turns:
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)
                rows = []
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(result(), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "formatted", "spans")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def write_formatted(conversations: DataFrame) -> DataFrame:
    """The formatted segments as a written table."""
    return written(format_conversations(conversations), "chat")
