"""Chat formatting with a grammar round trip.

The template is one line of turns:

    conversation := turn*
    turn         := OPEN role "\\n" body CLOSE "\\n"
    body         := text without a bare control string

A control string inside a text is written with a backslash after its first character
(`</s>` as `<\\/s>`); one that already has n backslashes there gets one more. The parser takes one
backslash off each. Rendering starts without any escape: the turn is parsed again, and as long as
the parser stops early or returns another text, the control string at fault is escaped in the
text. It ends after at most one round for each control string, when the parsed turn is identical.
Roles stand on one line: in them backslash, line feed, `<` and `[` are always escaped.

A turn is rendered from its own row alone, so formatting needs no shuffle. Reading back walks each
conversation in order, as a stream over a sorted partition: memory holds one turn, however long the
conversation is.

Null text is empty, null role is the role "". Order: turn, then role, then text; null turns come
first. Repeated rows are turns of their own. A null conversation id is one conversation. Columns
other than the four are not read. The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's marks and the control strings of common chat templates.
OPEN = "<|im_start|>"
CLOSE = "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"

_FAMILY = {c: re.compile(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:])) for c in CONTROL}
_ANY = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_ROLE = {"\\": "\\\\", "\n": "\\n", "<": "\\l", "[": "\\b"}
_ROLE_BACK = {v: k for k, v in _ROLE.items()}


def write_role(role: str) -> str:
    return re.sub(r"[\\\n<\[]", lambda m: _ROLE[m[0]], role)


def read_role(written: str) -> str:
    return re.sub(r"\\.", lambda m: _ROLE_BACK[m[0]], written)


def bare(found: str) -> str:
    """The control string of a match with or without backslashes."""
    return found[0] + found[1:].lstrip("\\")


def escape(text: str, control: str) -> str:
    """One backslash more in every form of one control string."""
    return _FAMILY[control].sub(lambda m: control[0] + m[1] + "\\" + control[1:], text)


def unescape(body: str) -> str:
    """One backslash less in every escaped form."""
    return _ANY.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], body)


class GrammarError(ValueError):
    """A text that is not a conversation; `control` is the bare control string that was met."""

    def __init__(self, message: str, control: str | None = None):
        super().__init__(message)
        self.control = control


def parse_turn(text: str, at: int = 0) -> tuple[str, int, int, int]:
    """Role, start and end of the body, and the end of the turn that begins at `at`."""
    if not text.startswith(OPEN, at):
        raise GrammarError(f"no turn begins at {at}")
    line = text.find("\n", at)
    if line < 0:
        raise GrammarError("a turn without a role line")
    start = end = line + 1
    while True:
        found = _ANY.search(text, end)
        if found is None:
            raise GrammarError("a turn that does not end")
        end = found.end()
        if found[0][1] != "\\":
            break
    if found[0] != CLOSE or not text.startswith("\n", end):
        raise GrammarError(f"{found[0]} inside a body", found[0])
    return read_role(text[at + len(OPEN) : line]), start, found.start(), end + 1


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation."""
    at, out = 0, []
    while at < len(text):
        role, start, end, at = parse_turn(text, at)
        out.append((role, unescape(text[start:end])))
    return out


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as text, and the span of its body: escaped until parsing gives back role and text."""
    body = text
    escaped: set[str] = set()
    while True:
        head = f"{OPEN}{write_role(role)}\n"
        made = f"{head}{body}{CLOSE}\n"
        fault = None
        try:
            got, start, end, stop = parse_turn(made)
            if stop == len(made) and got == role and unescape(made[start:end]) == text:
                return made, start, end
        except GrammarError as error:
            fault = error.control
        if fault is None or fault in escaped or _FAMILY[fault].search(text) is None:
            # a mismatch without a bare string: the first form in the text that is not escaped yet
            fault = next(c for c in (bare(m[0]) for m in _ANY.finditer(text)) if c not in escaped)
        escaped.add(fault)
        body = escape(body, fault)


def format_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, segment, body_start, body_end, loss: one row per turn.

    A conversation's formatted text is its segments in order; the spans count code points within
    the segment, and `loss` marks the turns whose body is learned from.
    """
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render_turn(r.as_py(), t.as_py()) for r, t in zip(batch.column(2), batch.column(3), strict=True)]
            cols = [pa.array([x[k] for x in made], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "segment", "body_start", "body_end"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    done = rows.mapInArrow(run, f"{kinds}, segment string, body_start long, body_end long")
    return done.withColumn("loss", F.col("role") == ASSISTANT)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_escaped, from segments only.

    Each segment is parsed; a segment that is not one turn is an error.
    """
    rows = formatted.select("conv_id", "turn", "role", "text", "segment", "body_start", "body_end", "loss")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "segment", "body_start", "body_end", "loss")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # id, turns, hash of turns, loss characters, hash of loss, characters, escaped turns
        out: list[tuple] = []

        def close() -> None:
            if now:
                out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))

        for batch in batches:
            key = batch.schema.field(0).type
            for conv, segment, start, end, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ((role, text),) = parse(segment)
                masked = unescape(segment[start:end])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    now[3] += len(masked)
                    now[4].update(masked.encode())
                now[5] += len(segment)
                now[6] += masked != segment[start:end]
            if len(out) > 1000:
                yield _table(out, names, key)
                out.clear()
        close()
        if out:
            yield _table(out, names, key)

    return placed.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long")


def _table(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def conversation_texts(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: whole conversations as one text each, for those that fit a row.

    Spans are (start, end) in code points of the formatted text.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text", "segment", "body_start", "body_end", "loss")
    rows = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    sizes = F.transform("t", lambda x: F.char_length(x["segment"]))
    before = F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.aggregate(F.slice(F.col("_n"), 1, i - 1), F.lit(0), lambda a, n: a + n))
    spans = F.filter(F.transform(F.arrays_zip("t", "_b"), lambda z: F.when(z["t"]["loss"], F.struct((z["_b"] + z["t"]["body_start"]).alias("start"), (z["_b"] + z["t"]["body_end"]).alias("end")))), lambda x: x.isNotNull())
    joined = rows.withColumn("_n", sizes).withColumn("_b", before)
    return joined.select("conv_id", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"), spans.alias("loss_spans"))
