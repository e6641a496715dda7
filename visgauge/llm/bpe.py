"""Byte-level BPE over whole texts: leaves of long texts are encoded in parallel and concatenated as a tree."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import in_arrow, slices

#: The split pattern of the byte-level pre-tokenizer; a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A place where a new pre-token starts whatever stands around: one blank between a visible byte and a letter or digit.
WORD_START = re.compile(rb"(?<=[!-~]) (?=[0-9A-Za-z])")
#: Tokens that must agree on either side of a join.
AGREE = 4


class Vocabulary:
    """A byte-level BPE tokenizer file, as tables: the encoder and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["post_processor"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for i, merge in enumerate(model["merges"]):  # merges in the order of ids: ranks and merges say the same
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if model["vocab"][left + right] != 256 + i:
                raise ValueError(f"{path} has merges out of the order of its ids")
        self._encoder = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks={k: v for k, v in ranks.items() if v not in specials.values()}, special_tokens=specials)
        self._specials = set(specials)
        self.longest_special = max((len(s.encode()) for s in specials), default=0)
        size = max([*ranks.values(), *specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in specials.items())]:
            self.bytes_of[i] = token

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._encoder.encode(text, allowed_special=self._specials, disallowed_special=()), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _cut(self, ids: np.ndarray, want: int, from_end: bool) -> int:
        """A token boundary at least `want` tokens from the join that starts a word, or else a character."""
        n = len(ids)
        i = n - want if from_end else want
        step = -1 if from_end else 1
        fallback = None
        for k in range(i, 0 if from_end else n, step):
            before, after = self.bytes_of[ids[k - 1]], self.bytes_of[ids[k]]
            if WORD_START.search(before[-1:] + after[:2] if len(after) > 1 else before[-1:] + after + self.bytes_of[ids[k + 1]][:1] if k + 1 < n else b""):
                return k
            if fallback is None and not 0x80 <= after[0] < 0xC0:
                fallback = k
            if abs(k - i) >= max(want, 64) and fallback is not None:
                return fallback
        return 0 if from_end else n

    def concatenate(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of the whole, from the ids of its two parts.

        A window around the join is encoded anew and grows until its ends agree with both parts. Both ends of the
        window start at a word, where any encoding starts a new pre-token, or, in a run without words, at a token: a
        sequence whose neighbours each stand side by side in some encoding is itself the encoding of its text.
        """
        want = max(16, self.longest_special + AGREE)
        while True:
            i = self._cut(left, want, True) if want < len(left) else 0
            j = self._cut(right, want, False) if want < len(right) else len(right)
            window = self.encode(self.decode([*left[i:].tolist(), *right[:j].tolist()]).decode())
            first = i == 0 or np.array_equal(window[:AGREE], left[i : i + AGREE])
            last = j == len(right) or np.array_equal(window[-AGREE:], right[max(j - AGREE, 0) : j])
            if first and last:
                return np.concatenate([left[:i], window, right[j:]])
            want *= 2


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def leaves(text: str, most: int) -> list[str]:
    """text in halves of halves, in order, until none is longer than most characters."""
    if len(text) <= most:
        return [text]
    middle = len(text) // 2
    return leaves(text[:middle], most) + leaves(text[middle:], most)


def concatenate_tree(voc: Vocabulary, parts: list[np.ndarray]) -> np.ndarray:
    """Join neighbours level by level; as leaves() halves evenly up to one character, depths differ by one at most."""
    while len(parts) > 1:
        parts = [voc.concatenate(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def _encode_whole(path: str, chars: int = 1 << 19) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last column of each batch, encoded; batches are cut where their texts sum up to half a million characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            first, size, rows = 0, 0, []
            for i in range(b.num_rows):
                text = b.column(b.num_columns - 1)[i].as_py() or ""
                rows.append(voc.encode(text))
                size += len(text)
                if size >= chars or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(first, i + 1 - first).columns[:-1], _id_lists(rows)], [*b.schema.names[:-1], "ids"])
                    first, size, rows = i + 1, 0, []

    return run


def _cut_leaves(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                parts = leaves(b.column(2)[k].as_py(), most)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(c)[k].as_py()] * n, pa.int64()) for c in (0, 1)] + [pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], ["row", "id", "leaf", "text"])

    return run


def _join_leaves(path: str, decoded: bool) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("leaf")
        parts = [np.array(x.values.to_numpy(), np.int32) for x in group.column("ids")]
        whole = pa.Table.from_arrays([group.column("id").slice(0, 1), _id_lists([concatenate_tree(vocabulary(path), parts)])], ["id", "ids"])
        return pa.Table.from_batches(_decode_lists(path, 1)(iter(whole.to_batches()))) if decoded else whole

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 32768, decoded: bool = False) -> DataFrame:
    """id_col and ids array<int> for every row of docs; a null text is encoded as the empty text.

    The ids are those of the tokenizers library for the file at path, with special tokens of the file recognised in the
    text and none added. Texts of more than leaf_chars characters are cut into halves of halves; leaves are dealt to
    all tasks, and those of one text meet again as ids. Repeated and null ids are rows of their own. With decoded the
    column that decode() adds is made where the ids are: decode(encode()) would keep two Python workers for each core.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    encode_whole, more = _encode_whole(path), ", decoded string" if decoded else ""
    decode_ids = _decode_lists(path, 1) if decoded else iter
    short = rows.where(F.length("text") <= leaf_chars).transform(in_arrow, lambda batches: decode_ids(encode_whole(batches)), f"id bigint, ids array<int>{more}")
    long = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text").where(F.length("text") > leaf_chars)
    cut = long.transform(in_arrow, _cut_leaves(leaf_chars), "row bigint, id bigint, leaf int, text string").repartition("row", "leaf")
    encoded = cut.transform(in_arrow, encode_whole, "row bigint, id bigint, leaf int, ids array<int>")
    joined = encoded.groupBy("row").applyInArrow(_join_leaves(path, decoded), f"id bigint, ids array<int>{more}")
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def _decode_lists(path: str, place: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each batch with the text of the ids in the column at place, in parts of few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for s in slices(batches, 128):
            ids = (x.values.to_numpy().tolist() if x.is_valid else None for x in s.column(place))
            texts = pa.array([None if x is None else voc.decode(x).decode(errors="replace") for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*s.columns, texts], [*s.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with the column decoded: the text of its ids (null ids: null)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.transform(in_arrow, _decode_lists(path, encoded.columns.index(ids_col)), f"{fields}, decoded string")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
