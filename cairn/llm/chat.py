"""Chat formatting with a grammar round trip.

A conversation is a sequence of turns `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. The parser is deterministic: it reads a
turn up to the first end mark, refuses it if its role or text holds a start or end mark, then undoes escapes (in a text,
one backslash goes from `<\\|`, `<\\\\|`, ...; in a role, `\\x` stands for x, with n for a line feed and l for `<`). The
renderer writes turns as they are, reparses what it wrote and escapes the turns that came back different, until what
comes back is what went in. So no text or role of the result holds a mark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_ROLE = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_BACK = {"n": "\n", "l": "<"}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return re.sub(r"[\\\n<]", lambda m: _ROLE[m[0]], role)


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ROLE_BACK.get(m[1], m[1]), role, flags=re.S)


def parse(formatted: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]] | None:
    """Turns, and the span of each turn's text in the formatted string; None if it isn't of the grammar."""
    turns, spans, at = [], [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m or any(mark in part for part in m.groups() for mark in (START, END)):
            return None
        turns.append((_role_back(m[1]), unescape(m[2])))
        spans.append(m.span(2))
        at = m.end()
    return turns, spans


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]], list[tuple[int, int]]]:
    """The formatted string, and what the parser reads from it: turns equal to those given, and their text spans."""
    escaped: set[int] = set()
    while True:
        said = "".join(
            f"{START}{_role(r) if i in escaped else r}\n{escape(t) if i in escaped else t}{END}\n" for i, (r, t) in enumerate(turns)
        )
        got = parse(said)
        if got and got[0] == turns:
            return said, *got
        # A turn that doesn't come back alone conflicts. If each does, the whole does too: the parser reads turn by turn.
        bad = {i for i, (r, t) in enumerate(turns) if i not in escaped and (parse(f"{START}{r}\n{t}{END}\n") or [None])[0] != [(r, t)]}
        if not bad:
            raise ValueError("an escaped turn does not come back")
        escaped |= bad


def format_chats(conversations: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns (read back: role, text), mask (spans in code points), loss_text (unescaped, in order).

    Turns are ordered by turn, then role, then text; null turns come first, a null role or text is empty; a null
    conv_id is a conversation of its own; repeated rows are repeated turns. A conversation is one row of the result,
    so its turns meet in one task, and only those.
    """
    turns = conversations.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )
    out = "formatted string, turns array<struct<role:string,text:string>>, mask array<struct<start:long,stop:long>>, loss_text string"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for given in b.column("turns").to_pylist():
                said, back, spans = render([(t["role"], t["text"]) for t in given])
                mask = [s for (role, _), s in zip(back, spans) if role == learn_from]
                rows.append({
                    "formatted": said, "turns": [{"role": r, "text": t} for r, t in back],
                    "mask": [{"start": i, "stop": j} for i, j in mask], "loss_text": "".join(unescape(said[i:j]) for i, j in mask),
                })
            kinds = pa.schema([
                ("formatted", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                ("mask", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("loss_text", pa.string()),
            ])
            got = pa.RecordBatch.from_pylist(rows, kinds)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *got.columns], ["conv_id", *kinds.names])

    kind = dict(conversations.dtypes)["conv_id"]
    return turns.mapInArrow(run, f"conv_id {kind}, {out}")
