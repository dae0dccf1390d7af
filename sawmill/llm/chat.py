"""Chat formatting with a grammar round trip.

A rendered conversation is a sequence of turns without anything between them:

    user       <s>[INST] TEXT [/INST]
    assistant  (space)TEXT </s>
    any other  <<SYS>>ROLE<<SYS>>TEXT<</SYS>>

The parser is deterministic: the first characters tell the kind of turn, and a body runs to its bare closing string.  In
a body a backslash before a backslash or a control string makes the latter plain text; any other bare control string is
an error.  A turn is rendered as it is, parsed again and compared with its source.  If they differ, its backslashes and
control strings are escaped and it is parsed and compared again; no turn is returned that doesn't come back identical.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrowmap import small_batches

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_any = "|".join(map(re.escape, CONTROL))
_TOKEN = re.compile(rf"\\(\\|{_any})|({_any})")
_CONFLICT = re.compile(rf"\\|{_any}")
USER, USER_END, BOT, BOT_END, OTHER, OTHER_END = "<s>[INST] ", " [/INST]", " ", " </s>", "<<SYS>>", "<</SYS>>"


class GrammarError(ValueError):
    pass


def _body(text: str, at: int, end: str) -> tuple[str, int]:
    """The body that begins at ``at`` and the position behind its closing string."""
    out, last = [], at
    while m := _TOKEN.search(text, last):
        if m[1]:
            out.append(text[at : m.start()])
            out.append(m[1])
            at = last = m.end()
            continue
        begin = m.end() - len(end)
        if m[2] != end.strip() or begin < at or not text.startswith(end, begin):
            raise GrammarError(f"{m[2]} inside a body")
        out.append(text[at:begin])
        return "".join(out), m.end()
    raise GrammarError("a body without an end")


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(text):
        if text.startswith(USER, at):
            body, at = _body(text, at + len(USER), USER_END)
            turns.append(("user", body))
        elif text.startswith(OTHER, at):
            role, at = _body(text, at + len(OTHER), OTHER)
            body, at = _body(text, at, OTHER_END)
            turns.append((role, body))
        elif text.startswith(BOT, at):
            body, at = _body(text, at + len(BOT), BOT_END)
            turns.append(("assistant", body))
        else:
            raise GrammarError(f"no turn begins at {at}")
    return turns


def unescaped(text: str) -> str:
    """A body as it was before its backslashes and control strings were escaped; one that wasn't is left alone."""
    return _TOKEN.sub(lambda m: m[1] or m[0], text)


def _frame(role: str, text: str, escaped: bool) -> tuple[str, int, int]:
    """The rendered turn and the bounds of its text."""
    if escaped:
        text = _CONFLICT.sub(lambda m: "\\" + m[0], text)
        role = role if role in ("user", "assistant") else _CONFLICT.sub(lambda m: "\\" + m[0], role)
    head, tail = (USER, USER_END) if role == "user" else (BOT, BOT_END) if role == "assistant" else (OTHER + role + OTHER, OTHER_END)
    return head + text + tail, len(head), len(head) + len(text)


def render(role: str, text: str) -> tuple[str, int, int, bool]:
    """Rendered turn, bounds of its text, whether it had to be escaped."""
    for escaped in (False, True):
        out, begin, end = _frame(role, text, escaped)
        try:
            same = parse(out) == [(role, text)]
        except GrammarError:
            same = False
        if same:
            return out, begin, end, escaped
    raise GrammarError("the turn does not come back")


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: conv_id, turn, rendered, text_begin/text_end (code points, of the text inside ``rendered``), in_loss
    (assistant turns) and escaped.

    A conversation's rendered form is its turns' in order of (turn, role, text), nulls first.  Null roles and texts are
    empty; the empty role is an ordinary other role.  Repeated rows are turns of their own; rows without a conversation
    form one.  Other columns are not read.
    """
    conv, turn = df.schema[conv_col].dataType, df.schema[turn_col].dataType
    kinds = [T.StructField("conv_id", conv), T.StructField("turn", turn), T.StructField("_role", T.StringType()), T.StructField("_text", T.StringType())]
    fields = [T.StructField("rendered", T.StringType()), T.StructField("text_begin", T.LongType()), T.StructField("text_end", T.LongType()), T.StructField("in_loss", T.BooleanType()), T.StructField("escaped", T.BooleanType())]
    schema = T.StructType(kinds + fields)
    out = to_arrow_schema(schema)
    source = df.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))

    def run(batches):
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = [(*render(r, t), r == "assistant") for r, t in zip(roles, texts, strict=True)]
            columns = [[x[i] for x in rows] for i in (0, 1, 2, 4, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(c, out.field(4 + i).type) for i, c in enumerate(columns)]], schema=out)

    return small_batches(source).mapInArrow(run, schema)


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its rendered turns: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.  Roles and texts are the parser's; the loss is the text between text_begin and text_end
    of the turns that are in_loss, unescaped, so that a wrong mask shows.

    Turns are hash-partitioned by conversation and sorted, and each task runs over them as a stream: it holds one batch
    and two digest states, whatever a conversation's length (a digest of a whole conversation is sequential by nature).
    """
    schema = T.StructType([turns.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    out = to_arrow_schema(schema)

    def run(batches):
        now, state, done = object(), None, []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, out.field(i).type) for i, c in enumerate(zip(*done, strict=True))], schema=out)

        def close():
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, rendered, begin, end, in_loss in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(rendered)
                for role, text in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if in_loss:
                    masked = unescaped(rendered[begin:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            if len(done) >= 4096:
                yield table()
                done.clear()
        close()
        if done:
            yield table()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "_role", "_text")
    return ordered.select("conv_id", "rendered", "text_begin", "text_end", "in_loss").mapInArrow(run, schema)
