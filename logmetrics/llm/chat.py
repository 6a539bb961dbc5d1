"""Conversations as one text each, with the characters that carry loss.

The template marks every turn with a header and an end mark. Roles and texts are
escaped: a backslash goes before each backslash, ``#`` and ``<``, so no header
or end mark can be read from inside them and the original comes back by dropping
each escaping backslash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.llm.frames import col
from logmetrics.llm.template import compile_template

TEMPLATE = (
    "{% for turn in turns %}"
    "{{ '#' + '## ' }}{{ turn.role | escape_role }}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}"
    "{{ '</turn>' + '\\n' }}"
    "{% endfor %}"
)
_TEXT, _ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: A turn as written: header, text, end mark; an escaped character is taken whole.
_TURN = re.compile(r"### ((?:[^\\#<:]++|\\.)*): ((?:[^\\#<]++|\\.)*)</turn>\n", re.S)
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_SAID = pa.struct([("role", pa.string()), ("text", pa.string())])


def escape(text: str) -> str:
    return _TEXT.sub(r"\\\g<0>", text)


def escape_role(text: str) -> str:
    return _ROLE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape, "escape_role": escape_role}


def read_turns(formatted: str) -> list[dict[str, str]]:
    """Roles and texts of a formatted conversation; an error if it is not made of whole turns."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append({"role": unescape(found[1]), "text": unescape(found[2])})
        at = found.end()
    return turns


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: str = TEMPLATE,
) -> DataFrame:
    """(conversation id, ``formatted``, ``loss_spans``): one row a conversation, its turns in order.

    ``loss_spans`` are the character ranges that a model is trained to produce.
    Turns are ordered by number (null first), then role and text; null roles and
    texts are empty; repeated rows are repeated turns; rows without a
    conversation id form one conversation; other columns are not looked at; an
    empty table gives an empty one. A conversation is one text, so its turns
    meet in one task.
    """
    empty = F.lit("")
    row = F.struct(
        col(turn_col).alias("turn"),
        F.coalesce(col(role_col), empty).alias("role"),
        F.coalesce(col(text_col), empty).alias("text"),
    )
    whole = turns.groupBy(col(conv_col).alias(conv_col)).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    whole = whole.select(col(conv_col), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [whole.schema[0], T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(span))]
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template, FILTERS)
        for batch in batches:
            texts, spans = [], []
            for roles, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = [{"role": r, "text": t} for r, t in zip(roles, said, strict=True)]
                text, marks = run({"turns": rows})
                texts.append(text)
                spans.append([{"begin": b, "end": e} for b, e in marks])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(_SPAN))], schema.names
            )

    return whole.mapInArrow(render, schema)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Result of :func:`format_conversations` with ``turns`` and ``loss_texts`` read back from it."""
    said = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType(
        [*formatted.schema.fields, T.StructField("turns", T.ArrayType(said))]
        + [T.StructField("loss_texts", T.ArrayType(T.StringType()))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = [read_turns(t) for t in texts]
            loss = [
                [unescape(t[s["begin"] : s["end"]]) for s in spans]
                for t, spans in zip(texts, batch.column("loss_spans").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(turns, pa.list_(_SAID)), pa.array(loss, pa.list_(pa.string()))],
                [*batch.schema.names, "turns", "loss_texts"],
            )

    return formatted.mapInArrow(read, schema)
