"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<s>" "[INST]" role "[/INST]" text "</s>"

Inside a field a backslash before ``\\``, ``<`` or ``[`` makes that character plain.
A deterministic parser reads any rendered text back.  A turn is first rendered as it
is; if the parser does not give back exactly its role and text, the conflicting
field is escaped (first the control strings in it, then every character that could
take part in one) and the turn is parsed again, until both are identical.

The loss mask covers the text field of assistant turns, as code-point spans.

Turns are rendered one by one where they lie.  To read conversations back, the
pieces are dealt by conversation, sorted by Spark (which spills) and streamed through
the parser with running digests: a conversation of any length needs one turn of
memory.  Its digests are sequential by nature, so one conversation is read by one
task; rendering and checking, the costly part, is spread over all tasks.

Null texts and roles are empty.  Null conversation ids form one conversation.  Turns
with the same number are ordered by role, then text; repeated rows stay repeated.  Texts of any length are
rendered whole.  An empty table gives an empty one.  Extra columns are not read; a column of conversations or turns named as a result is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridleaf.llm.shared import chunks, no_clash

OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST]", "[/INST]"
ASSISTANT = "assistant"
_CONTROL = re.compile(r"</?s>|\[/?INST\]")
_TOKEN = re.compile(r"\\[\\<\[]|</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\([\\<\[])")
_ORDER = (OPEN, BEGIN, END, CLOSE)


class NotInGrammar(ValueError):
    """A text that the grammar does not produce."""


def unescape(field: str) -> str:
    return _ESCAPED.sub(r"\1", field) if "\\" in field else field


def escape(field: str, level: int) -> str:
    """Level 0: as it is; 1: control strings and backslashes; 2: every character that can take part."""
    if level == 0:
        return field
    if level == 1:
        return _CONTROL.sub(lambda m: "\\" + m[0], field.replace("\\", "\\\\"))
    return re.sub(r"[\\<\[]", r"\\\g<0>", field)


def parse(rendered: str) -> list[tuple[str, str, tuple[int, int]]]:
    """Role, text and span of the text field of each turn; NotInGrammar for any other text."""
    turns, state, at, role = [], 0, 0, ""
    for token in _TOKEN.finditer(rendered):
        found = token[0]
        if found[0] == "\\":
            continue
        if found != _ORDER[state] or (state < 2 and token.start() != at):
            raise NotInGrammar(f"{found} at {token.start()}")
        if state == 2:
            role = unescape(rendered[at : token.start()])
        elif state == 3:
            turns.append((role, unescape(rendered[at : token.start()]), (at, token.start())))
        at = token.end()
        state = (state + 1) % 4
    if state or at != len(rendered):
        raise NotInGrammar("the text ends inside a turn")
    return turns


def render(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """A turn that parses back to exactly this role and text, and the span of its text field."""
    levels = [0, 0]
    while True:
        fields = escape(role, levels[0]), escape(text, levels[1])
        rendered = f"{OPEN}{BEGIN}{fields[0]}{END}{fields[1]}{CLOSE}"
        try:
            turns = parse(rendered)
        except NotInGrammar:
            turns = []
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, turns[0][2]
        # Escape the field that conflicts by itself; a conflict of both together escapes both.
        alone = []
        for i, field in enumerate(fields):
            try:
                back = parse(f"{OPEN}{BEGIN}{END}{field}{CLOSE}")
                alone.append(len(back) != 1 or back[0][1] != (role, text)[i])
            except NotInGrammar:
                alone.append(True)
        if not any(alone):
            alone = [True, True]
        levels = [level + bad for level, bad in zip(levels, alone, strict=True)]
        if max(levels) > 2:
            raise NotInGrammar("no escaping round trips")


def render_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversation, turn, rendered, where its text field begins, and the loss span (loss_from, loss_to) in it, null for other roles."""
    no_clash([conversation, turn], ["rendered", "text_from", "loss_from", "loss_to"])
    schema = T.StructType([df.schema[conversation], df.schema[turn], *T._parse_datatype_string("rendered string, text_from long, loss_from long, loss_to long").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 3):
                roles, texts = ([x or "" for x in part.column(i).to_pylist()] for i in (2, 3))
                made = [render(r, t) for r, t in zip(roles, texts, strict=True)]
                masked = [r == ASSISTANT for r in roles]
                columns = [[m[0] for m in made], [m[1][0] for m in made], *([m[1][i] if own else None for m, own in zip(made, masked, strict=True)] for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), part.column(1).cast(arrow.field(1).type), *(pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[2:], strict=True))], schema=arrow)

    return df.select(conversation, turn, role, text).mapInArrow(run, schema)


def read_back(rendered: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation, from the rendered turns and loss spans alone: counts, digests of turns and of the text under the mask."""
    no_clash([conversation], ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    schema = T.StructType([rendered.schema[conversation], *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        counts = [0, 0, 0]
        turns, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
            done.clear()
            return batch

        for batch in batches:
            for part in chunks(batch, 1):
                for key, piece, start, stop in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if key != now or now is run:
                        if now is not run:
                            done.append((now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                        now, counts = key, [0, 0, 0]
                        turns, loss = hashlib.sha256(), hashlib.sha256()
                    for role, text, _ in parse(piece):
                        turns.update(f"{role}\n{text}\n".encode())
                        counts[0] += 1
                    if start is not None:
                        under = unescape(piece[start:stop])
                        loss.update(under.encode())
                        counts[1] += len(under)
                    counts[2] += len(piece)
                if done:
                    yield flush()
        if now is not run:
            done.append((now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
            yield flush()

    # Turns of one number by role, then text, read from the rendered turn after the shuffle.
    head, middle = len(OPEN + BEGIN), len(END)
    plain = lambda field: F.regexp_replace(field, r"\\([\\<\[])", "$1")
    role = plain(F.expr(f"substring(rendered, {head + 1}, int(text_from) - {head + middle})"))
    text = plain(F.expr(f"substring(rendered, int(text_from) + 1, length(rendered) - int(text_from) - {len(CLOSE)})"))
    order = [F.col(conversation), F.col(turn), role, text]
    dealt = rendered.repartition(F.col(conversation)).sortWithinPartitions(*order)
    return dealt.select(conversation, "rendered", "loss_from", "loss_to").mapInArrow(run, schema)
