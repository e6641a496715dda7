"""Fill-in-the-middle: documents cut at two lines and put together anew, and the way back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm import rope
from visgauge.llm.common import in_arrow


@dataclass(frozen=True)
class Marks:
    """The strings before prefix, suffix and middle. None may hold another, nor end as it or another begins: then no
    mark can arise across a seam, and each is found again at its first place."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.all()
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                longest = min(len(a), len(b)) - (i == j)
                if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, longest + 1)):
                    raise ValueError(f"the marks {marks} can't be told apart in every text")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the seed and the id alone."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))


def rearrange(text: str, numbers: tuple[int, int, int, int], marks: Marks, percent: int, spm_percent: int, leaf_chars: int) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, code points of prefix and middle, and the output of one text."""
    whole = rope.build(text, leaf_chars)
    n = rope.units(whole)
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= percent or any(m in text for m in marks.all()):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = rope.split_units(whole, first)
    middle, suffix = rope.split_units(rest, second - first)
    p, s, m = map(rope.leaf, marks.all())
    spm = h4 % 100 < spm_percent
    parts = (s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)
    out = rope.EMPTY
    for part in parts:
        out = rope.join(out, part)
    return n, "spm" if spm else "psm", prefix.chars, middle.chars, rope.flat(out)


def restore(output: str, form: str, marks: Marks, leaf_chars: int) -> str:
    """The text that rearrange() made output of."""
    if form == "plain":
        return output
    outer, inner = (marks.suffix, marks.prefix) if form == "spm" else (marks.prefix, marks.suffix)
    second = output.index(inner, len(outer))
    third = output.index(marks.middle, second + len(inner))
    rest, middle = rope.split_chars(rope.build(output, leaf_chars), third + len(marks.middle))
    rest, _ = rope.split_chars(rest, third)
    rest, two = rope.split_chars(rest, second + len(inner))
    rest, _ = rope.split_chars(rest, second)
    _, one = rope.split_chars(rest, len(outer))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return rope.flat(rope.join(rope.join(prefix, middle), suffix))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", percent: int = 100, spm_percent: int = 50, marks: Marks = Marks(), leaf_chars: int = 4096) -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars and output of every row of docs.

    A text is cut at two of its n line borders that hang on the seed and its id alone, whatever the partition or the
    attempt, and put together as marked prefix, suffix and middle (psm) or suffix, prefix and middle (spm). It stays as
    it is (plain; the counts are null) if it is empty or null, if it holds a mark, and for all but `percent` of the
    ids; spm is for `spm_percent` of them. Repeated rows are rows of their own, with one result; null ids are one id.
    Each text is a tree of leaves of leaf_chars code points that cache their lines and code points: cuts go down one
    path, and the parts are joined as subtrees. Nothing is shuffled, and a text of any length is in memory twice.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                s = b.slice(i, 128)
                ids = s.column(0).to_pylist()
                made = [rearrange(t.as_py(), draws(seed, k), marks, percent, spm_percent, leaf_chars) for k, t in zip(ids, s.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True))], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.transform(in_arrow, run, "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


def restore_texts(filled: DataFrame, marks: Marks = Marks(), leaf_chars: int = 4096) -> DataFrame:
    """The rows of fill_in_middle() with the column restored: the text, from form and output alone (null if one is)."""
    names = filled.columns
    if "restored" in names:
        raise ValueError("the rows have a column restored already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                s = b.slice(i, 128)
                pairs = ((o.as_py(), f.as_py()) for o, f in zip(s.column(names.index("output")), s.column(names.index("form")), strict=True))
                texts = pa.array([None if o is None or f is None else restore(o, f, marks, leaf_chars) for o, f in pairs], pa.string())
                yield pa.RecordBatch.from_arrays([*s.columns, texts], [*names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filled.schema.fields)
    return filled.transform(in_arrow, run, f"{fields}, restored string")
