"""Chat formatting with offset-aligned loss masks: whole conversations are rendered and encoded once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import in_arrow
from visgauge.llm.bpe import Vocabulary, vocabulary

#: Stands before each role, before each text and at the end. As a special token of the vocabulary it never shares a
#: token with a text, so that the spans of texts and of tokens have their ends in common.
MARK = "<|endoftext|>"


def escape(text: str) -> str:
    """text such that MARK cannot occur in it: backslashes doubled, and one put into each `<|`."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\\\|\\(?=\|)", lambda m: "\\" if len(m[0]) == 2 else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation of (role, text) turns, and the span of each text in it, in bytes."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{MARK}<turn {escape(role)}>{MARK}", escape(text)
        at += len(head.encode())
        size = len(body.encode())
        spans.append((at, at + size))
        at += size
        out += [head, body]
    return "".join([*out, MARK]), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    parts = formatted.split(MARK)[1:-1]
    return [(unescape(head[len("<turn ") : -1]), unescape(body)) for head, body in zip(parts[::2], parts[1::2], strict=True)]


def mask(token_ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token, whether it lies in one of the sorted spans; both ends of each span are found by bisection."""
    first = np.searchsorted(token_ends, spans[:, 0], "right")
    last = np.searchsorted(token_ends, spans[:, 1], "right")
    steps = np.zeros(len(token_ends) + 1, np.int32)
    full = last > first
    np.add.at(steps, first[full], 1)
    np.add.at(steps, last[full], -1)
    return np.cumsum(steps[:-1]) > 0


def _encode(voc: Vocabulary, turns: list[tuple[str, str]], loss_role: str) -> tuple[str, np.ndarray, np.ndarray]:
    formatted, spans = render(turns)
    ids = voc.encode(formatted)
    ends = np.cumsum([len(voc.bytes_of[i]) for i in ids.tolist()], dtype=np.int64)
    wanted = np.array([s for s, (role, _) in zip(spans, turns, strict=True) if role == loss_role], np.int64).reshape(-1, 2)
    return formatted, ids, mask(ends, wanted)


def format_conversations(
    turns: DataFrame, path: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: id_col, formatted string, ids array<int>, loss array<boolean> (a flag for each id).

    Rows are put in the order of turn, then role, then text, nulls first; all rows count, repeated ones too. Null roles
    and texts are empty. Rows with a null id form a conversation of their own. A conversation is one row, as it is rendered
    and encoded whole: it must fit one task. The mask covers the texts of loss_role
    and nothing else.
    """
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                done = [_encode(voc, [(t["role"], t["text"]) for t in x], loss_role) for x in s.column(1).to_pylist()]
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds))], ["id", "formatted", "ids", "loss"])

    return whole.transform(in_arrow, run, "id bigint, formatted string, ids array<int>, loss array<boolean>").withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, path: str, id_col: str = "conv_id") -> DataFrame:
    """id_col, n_turns, turns (role, line feed, text, line feed for each turn), loss_text and formatted_chars, all taken
    from the formatted text, the ids and the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            rows = []
            for text, ids, loss in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                turns = parse(text)
                under = voc.decode([i for i, m in zip(ids, loss, strict=True) if m]).decode()
                rows.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), unescape(under), len(text)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["id", "n_turns", "turns", "loss_text", "formatted_chars"])

    rows = formatted.select(F.col(id_col).alias("id"), "formatted", "ids", "loss")
    return rows.transform(in_arrow, run, "id bigint, n_turns bigint, turns string, loss_text string, formatted_chars bigint").withColumnRenamed("id", id_col)


