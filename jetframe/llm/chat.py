"""Chat formatting by prefix-target expansion.

Every assistant turn becomes its own example: all preceding turns as context, then that reply, which
alone is trainable (its span is the loss mask). Turns after the last assistant turn, or a conversation
without one, end in a last example without a target, so that no turn is lost.

Template: ``### role: text</turn>`` and a line feed per turn. Inside roles and texts a backslash, ``#``
and ``</turn>`` (in roles ``:`` too) are escaped by a backslash, so neither marker can occur in them,
and the reader restores every text.

Turns are ordered by (turn, role, text); a repeated row is a turn of its own. Null roles and texts are
empty. A null conv_id is a conversation too. An empty table gives no examples; further columns are
ignored. A conversation is read by one task in sorted order. The task keeps the text of the one
conversation at hand and gives its examples in batches of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
BATCH_CHARS = 1 << 20
EXAMPLES = (
    "conv_id bigint, example int, target int, text string, loss_start bigint, loss_end bigint"
)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_RESTORED = {"\\": "\\", "#": "#", "e": "</turn>", "c": ":"}
_TURN = re.compile(r"### (.*?): (.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "\\e")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _RESTORED[m.group(1)], text)


def render(role: str, text: str) -> tuple[str, str, str]:
    """(marker before, escaped text, marker after)."""
    return f"{HEAD}{escape(role).replace(':', chr(92) + 'c')}{COLON}", escape(text), TAIL


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def examples_of(turns: list[tuple[str, str]]) -> Iterator[tuple[int | None, str, int, int]]:
    """(target turn or None, formatted text, loss start, loss end) of one conversation."""
    parts: list[str] = []
    size = 0
    whole, marks = [], []
    for place, (role, text) in enumerate(turns):
        before, body, after = render(role, text)
        start = size + len(before)
        parts += [before, body, after]
        size = start + len(body) + len(after)
        if role == ASSISTANT:
            marks.append((place, size, start, start + len(body)))
    whole = "".join(parts)
    for place, end, start, stop in marks:
        yield place, whole[:end], start, stop
    if turns and (not marks or marks[-1][0] != len(turns) - 1):
        yield None, whole, size, size


def _conversations(batches) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    current, turns = None, []
    for batch in batches:
        for conv, role, text in zip(
            *(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True
        ):
            if turns and conv != current:
                yield current, turns
                turns = []
            current = conv
            turns.append((role or "", text or ""))
    if turns:
        yield current, turns


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for conv, turns in _conversations(batches):
        for number, (place, text, start, stop) in enumerate(examples_of(turns)):
            rows.append((conv, number, place, text, start, stop))
            held += len(text)
            if held >= BATCH_CHARS:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    names = ["conv_id", "example", "target", "text", "loss_start", "loss_end"]
    return pa.record_batch(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
    )


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, target, text, loss_start, loss_end); spans count code points."""
    ordered = (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.select(F.col("conv_id").cast("bigint"), "role", "text").mapInArrow(
        _expand, EXAMPLES
    )


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads examples back; those of a conversation follow each other, its longest comes last."""
    out: list[tuple] = []
    state: dict | None = None

    def close(state: dict) -> tuple:
        turns = parse(state["text"])
        digest = hashlib.sha256()
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        return (
            state["conv"],
            len(turns),
            digest.hexdigest(),
            state["chars"],
            state["loss"].hexdigest(),
            state["formatted"],
        )

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [part.split()[0] for part in DIGESTS.split(", ")]
        columns = zip(zip(*found, strict=True), kinds, strict=True)
        return pa.record_batch([pa.array(c, k) for c, k in columns], names=names)

    for batch in batches:
        for row in range(batch.num_rows):
            conv, example, _, text, start, stop = (c[row].as_py() for c in batch.columns)
            if example == 0:
                if state:
                    out.append(close(state))
                state = {"conv": conv, "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
            trained = unescape(text[start:stop])
            state["chars"] += len(trained)
            state["loss"].update(trained.encode())
            state["formatted"] += len(text)
            state["text"] = text
        if out:
            yield rows(out)
            out = []
    if state:
        yield rows([close(state)])


def read_back(examples: DataFrame) -> DataFrame:
    """Digest columns per conversation, from the examples alone."""
    return examples.mapInArrow(_digests, DIGESTS)


HOSTILE = "\\### Assistant: </turn> ok"


def with_hostile(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts hold the template's own control strings."""
    rows = [(-7, 0, "user", HOSTILE), (-7, 1, ASSISTANT, HOSTILE)]
    extra = conversations.sparkSession.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").union(extra)
