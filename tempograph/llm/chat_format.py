"""Chat formatting with compiled templates (see templates), as a stream, and reading back.

A conversation's rows meet, sorted, in one task, which renders them one turn at a time and yields parts of a
bounded length that end with a turn; no conversation is ever held whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, templates

#: Control strings are made of < > and "; in a role or text these and the backslash are written as a backslash and a letter.
TEMPLATE = """{%- for turn in messages -%}
<turn role="{{ turn.role|escape }}">
{% if turn.role == 'assistant' %}{% generation %}{{ turn.text|escape }}{% endgeneration %}{% else %}{{ turn.text|escape }}{% endif %}
</turn>
{% endfor -%}"""
TURN = re.compile(r'<turn role="([^"]*)">\n([^<]*)\n</turn>\n')
MARKS = {"\\": "\\\\", "<": "\\l", ">": "\\g", '"': "\\q"}
ESCAPE, UNESCAPE = str.maketrans(MARKS), {v: k for k, v in MARKS.items()}
PART = 1 << 18
PARTS = "conv_id long, part long, formatted string, loss array<struct<start:int,end:int>>"


def escape(x: str) -> str:
    return (x or "").translate(ESCAPE)


def unescape(x: str) -> str:
    return re.sub(r"\\.", lambda m: UNESCAPE[m[0]], x)


@functools.lru_cache(maxsize=4)
def renderer(source: str):
    return templates.compiled(source, {"escape": escape})


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def formatted(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """PARTS of turns(conv_id, turn, role, text): the conversations' text in parts, sorted within partitions, and the spans under the loss mask.

    Turns go by turn, ties by role, then text; nulls first, null roles and texts as empty ones; repeated rows are
    turns of their own. The rows of a null conv_id are one conversation. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = renderer(template)
        for conv, rows in groupby(rows_of(batches), key=lambda r: r["conv_id"]):
            own, loss, size, part = [], [], 0, 0
            for piece, mask in render({"messages": rows}):
                if mask and piece:
                    loss.append({"start": size, "end": size + len(piece)})
                own.append(piece)
                size += len(piece)
                if size >= PART and piece.endswith("</turn>\n"):
                    yield made(conv, part, own, loss)
                    own, loss, size, part = [], [], 0, part + 1
            yield made(conv, part, own, loss)

    def made(conv, part: int, own: list[str], loss: list[dict]) -> pa.RecordBatch:
        spans = pa.array([loss], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array(["".join(own)], pa.string()), spans], ["conv_id", "part", "formatted", "loss"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, read from formatted()'s rows in their order: the turns from the text, the loss from its spans."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        for conv, rows in groupby(rows_of(batches), key=lambda r: r["conv_id"]):
            turns, loss, n, chars, size = sha256(), sha256(), 0, 0, 0
            for r in rows:
                at, whole = 0, r["formatted"]
                for m in TURN.finditer(whole):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv}: no turn at {at}")
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n, at = n + 1, m.end()
                if at != len(whole):
                    raise ValueError(f"conversation {conv}: text after the last turn")
                for s in r["loss"]:
                    own = unescape(whole[s["start"] : s["end"]])
                    loss.update(own.encode())
                    chars += len(own)
                size += len(whole)
            for column, x in zip(out, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size), strict=True):
                column.append(x)
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k.endswith("256") else pa.int64()) for c, k in zip(out, names, strict=True)], names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k.endswith("256") else pa.int64()) for c, k in zip(out, names, strict=True)], names)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(turns.unionByName(more)))
