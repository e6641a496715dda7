"""Alignment of two tokenizers' tokens, each distinct segment of the corpus tokenised and aligned once."""

from __future__ import annotations

import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.llm.bpe import Vocabulary, concatenate_tree, leaves
from visgauge.llm.common import in_arrow, shared_folder

#: White space by Unicode, and the sign that pieces have for a blank.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\u2581"
BLANK = "\u2581"


class Plain(Vocabulary):
    """A byte-level vocabulary for which the strings of special tokens are plain text."""

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._encoder.encode_ordinary(text), np.int32)

    def encode_long(self, text: str, most: int = 32768) -> np.ndarray:
        return self.encode(text) if len(text) <= most else concatenate_tree(self, [self.encode(x) for x in leaves(text, most)])


class Pieces:
    """A sentencepiece model that puts a blank before a text, changes none of its characters, and falls back on bytes."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.blank = self.model.piece_to_id(BLANK)
        probe = "a  b \n c"
        if b"".join(self.bytes_of[i] for i in self.model.encode(probe)) != b" " + probe.encode():
            raise ValueError(f"{path} changes white space, or puts no blank before a text")

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """The ids of segments, the first character of which is a blank or no part of any piece but its byte."""
        found = self.model.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                found[k] = [self.blank]
            elif s[0] != " ":  # less the blank put before it, which merges with no such character
                if found[k][0] != self.blank:
                    raise ValueError("a blank merged with the white space after it")
                del found[k][0]
        return found


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> tuple[Plain, Pieces]:
    return Plain(path_a), Pieces(path_b)


def split_before(a: Vocabulary, b: Pieces) -> str:
    """The white space characters that a run may start with where a text is cut: those which, by the vocabularies, no
    token of either tokenizer holds behind a visible character. But for the blank, b must not know the character at all
    (then it is a byte of its own, and the blank that b puts before a text can be taken off again). The pattern of a
    starts a pre-token at such a run, whatever stands before it."""
    found = ""
    for c in " \n\t":
        behind = re.compile(f"[^{SPACES}]{c}")
        held = re.compile(f"[^{BLANK}]{BLANK}" if c == " " else c)
        if not any(map(held.search, b.pieces)) and not any(behind.search(t.decode(errors="replace")) for t in a.bytes_of):
            found += c
    return found


def segment_pattern(first: str) -> re.Pattern[str]:
    """Runs of white space with what follows, in a text that starts with a blank; a run whose first character isn't one
    of `first` starts none, and all of the text is one segment if the blank isn't one."""
    if " " not in first:
        return re.compile(r"(?s).+")
    starts = "".join(map(re.escape, first))
    rest = "".join(c for c in SPACES if c not in first)
    return re.compile(f"[{starts}][{SPACES}]*[^{SPACES}]*(?:[{rest}][{SPACES}]*[^{SPACES}]*)*")


class Numbers(dict):
    """A number for each key, in the order in which they are first seen."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def zipped(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unzipped(data: bytes) -> bytes:
    return pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def squeezed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Whole numbers of one kind, compressed byte plane by byte plane."""
    return zipped(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes())


def unsqueezed(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzipped(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def zipped_texts(texts: list[str]) -> bytes:
    raw = [x.encode() for x in texts]
    lengths = squeezed(np.array(list(map(len, raw)), np.int64))
    return len(lengths).to_bytes(4, "little") + lengths + zipped(b"".join(raw))


def unzipped_texts(data: bytes) -> list[str]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unsqueezed(data[4 : 4 + n]), dtype=np.int64).tolist()
    raw = unzipped(data[4 + n :])
    return [raw[i:j].decode() for i, j in zip([0, *ends], ends, strict=False)]


_CHUNKS = "chunk bigint, bucket int, segments binary, doc_ids array<bigint>, doc_lengths binary, ids binary, places binary"


def chunked(docs: DataFrame, path_a: str, path_b: str, chunk_chars: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Chunks of some documents of one task: a row of its documents (doc_ids, doc_lengths in segments, ids: the numbers of
    their segments in the chunk, places), and rows of its distinct segments, a row for those of each bucket of a hash.
    places are the segments' numbers in the order of the buckets' rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments_of = segment_pattern(split_before(*tokenizers(path_a, path_b))).findall
        chunk, size = TaskContext.get().partitionId() << 33, 0
        numbers, doc_ids, ids = Numbers(), [], []

        def finished() -> Iterator[pa.RecordBatch]:
            known = list(numbers)
            of = np.fromiter((zlib.crc32(x.encode()) % buckets for x in known), np.int32, len(known))
            places = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.diff(of[places], prepend=-1)) if len(known) else np.zeros(0, np.int64)
            held = [zipped_texts([known[k] for k in places[i:j]]) for i, j in zip(starts, [*starts, len(known)][1:], strict=True)]
            n = len(held)
            columns = [[chunk] * n, of[places[starts]], held, *[[None] * n] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            lengths, flat = np.array(list(map(len, ids)), np.int64), np.concatenate(ids)
            columns = [[chunk], [None], [None], [doc_ids], [squeezed(lengths)], [squeezed(flat)], [squeezed(places)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                doc_ids.append(doc_id)
                ids.append(np.fromiter(map(numbers.__getitem__, segments_of(" " + text) if text else ()), np.int32))
                size += len(text)
                if size >= chunk_chars or len(doc_ids) >= 1 << 20:
                    yield from finished()
                    chunk, size = chunk + 1, 0
                    numbers, doc_ids, ids = Numbers(), [], []
        if doc_ids:
            yield from finished()

    return rows.transform(in_arrow, run, _CHUNKS)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of runs that begin at starts, one after the other."""
    before = np.cumsum(lengths) - lengths
    kind = np.int32 if (starts[-1] + lengths[-1] if len(starts) else 0) < 1 << 31 and lengths.sum() < 1 << 31 else np.int64
    out = np.repeat((starts - before).astype(kind), lengths)
    out += np.arange(len(out), dtype=kind)
    return out


class Alignments:
    """The alignments of many segments: the number of links of each; for each link, in order, which tokens end with it (1:
    that of A, 2: that of B, 3: both, which ends a group too); and the ids of each segment, those of A before those of
    B. A segment that either tokenizer doesn't give back unchanged has no links."""

    def __init__(self, n_links: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        self.n_links, self.ends, self.bad = n_links.astype(np.int64), ends, n_links == 0
        self.at_links = np.concatenate([[0], np.cumsum(self.n_links)])
        self.n_a, self.n_b = (self._per_segment(self.ends & bit != 0) for bit in (1, 2))
        self.n_groups = self._per_segment(self.ends == 3)
        first = np.cumsum(self.n_a + self.n_b) - self.n_a - self.n_b
        self.a, self.b = ids[spread(first, self.n_a)], ids[spread(first + self.n_a, self.n_b)]

    def _per_segment(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at_links[1:]] - total[self.at_links[:-1]]

    def codes(self) -> np.ndarray:
        """The ids of each link, as one number."""
        ends_a, ends_b = self.ends & 1, self.ends >> 1
        at_a, at_b = (np.cumsum(e, dtype=np.int64) - e for e in (ends_a, ends_b))
        return (self.a.astype(np.int64)[at_a] << 32) | self.b.astype(np.int64)[at_b]

    def group_texts(self, slab: int = 1 << 14) -> np.ndarray:
        """The groups of each segment, as text; some segments at a time, each id written once."""
        out = np.empty(len(self.bad), object)
        written = {i: str(i) for ids in (self.a, self.b) for i in np.unique(ids).tolist()}
        at_a, at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        for first in range(0, len(out), slab):
            last = min(first + slab, len(out))
            ends = self.ends[self.at_links[first] : self.at_links[last]]
            cut_a, cut_b = (np.cumsum(ends & bit != 0)[ends == 3].tolist() for bit in (1, 2))
            a, b = ([written[i] for i in ids[at[first] : at[last]].tolist()] for ids, at in ((self.a, at_a), (self.b, at_b)))
            groups = [f"{','.join(a[i:j])}|{','.join(b[k:m])}" for i, j, k, m in zip([0, *cut_a][:-1], cut_a, [0, *cut_b][:-1], cut_b, strict=True)]
            at = np.concatenate([[0], np.cumsum(self.n_groups[first:last])]).tolist()
            out[first:last] = [groups[i] if j == i + 1 else ";".join(groups[i:j]) for i, j in zip(at, at[1:], strict=False)]
        return out


#: Links, ends and ids of a segment, as Alignments has them.
Aligned = tuple[int, bytes, bytes]


def id_kind(a: Plain, b: Pieces) -> str:
    return "<u2" if max(len(a.bytes_of), len(b.bytes_of)) <= 1 << 16 else "<u4"


def aligned(segments: list[str], a: Plain, b: Pieces) -> list[Aligned]:
    """The alignment of each segment.

    The segments that both tokenizers give back unchanged are laid end to end; their tokens' ends are merged once. The
    bytes between two ends lie in one token of each side, and are one link: two tokens meet in one such stretch.
    """
    kind, ids_a, ids_b = id_kind(a, b), [a.encode_long(s) for s in segments], b.encode_segments(segments)
    bytes_a, bytes_b = a.bytes_of, b.bytes_of
    whole = [s.encode() for s in segments]
    good = [b"".join([bytes_a[i] for i in x.tolist()]) == w == b"".join([bytes_b[i] for i in y]) for x, y, w in zip(ids_a, ids_b, whole, strict=True)]
    kept = [k for k, g in enumerate(good) if g]
    ends_a = np.cumsum([len(bytes_a[i]) for k in kept for i in ids_a[k].tolist()], dtype=np.int64)
    ends_b = np.cumsum([len(bytes_b[i]) for k in kept for i in ids_b[k]], dtype=np.int64)
    stretch = np.union1d(ends_a, ends_b)
    ends = (np.isin(stretch, ends_a) + 2 * np.isin(stretch, ends_b)).astype(np.uint8).tobytes()
    at = np.searchsorted(stretch, np.cumsum([0, *(len(whole[k]) for k in kept)]), "right").tolist()
    out = [(0, b"", b"")] * len(segments)
    for n, k in enumerate(kept):
        i, j = at[n], at[n + 1]
        out[k] = j - i, ends[i:j], ids_a[k].astype(kind).tobytes() + np.array(ids_b[k], kind).tobytes()
    return out


def align_segments(known: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """chunk, bucket, and n_links, ends and ids of the chunks' segments (chunk, bucket, segments). The rows of a bucket come
    to one task one after the other, where each distinct segment is tokenised and aligned once; the task keeps the
    alignments of one bucket in memory."""
    names = ["chunk", "bucket", "n_links", "ends", "link_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        kind, bucket, found = id_kind(a, b), None, {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                s = batch.slice(i, 256)
                rows = list(zip(s.column(1).to_pylist(), map(unzipped_texts, s.column(2).to_pylist()), strict=True))
                made: list[tuple[bytes, bytes, bytes]] = []
                for k, (own, segments) in enumerate(rows):
                    if own != bucket:
                        bucket, found = own, {}
                    if any(x not in found for x in segments):
                        ahead = list(itertools.takewhile(lambda r: r[0] == bucket, rows[k : k + 64]))  # align many at once
                        new = [x for x in dict.fromkeys(x for _, texts in ahead for x in texts) if x not in found]
                        found.update(zip(new, aligned(new, a, b), strict=True))
                    parts = [found[x] for x in segments]
                    n, ends, ids = zip(*parts, strict=True)
                    made.append((squeezed(np.array(n)), zipped(b"".join(ends)), squeezed(np.frombuffer(b"".join(ids), kind), kind)))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), *(pa.array(c, pa.binary()) for c in zip(*made, strict=True))], names)

    rows = known.select("chunk", "bucket", "segments").repartition("bucket").sortWithinPartitions("bucket")
    return rows.transform(in_arrow, run, "chunk bigint, bucket int, n_links binary, ends binary, link_ids binary")


_PACKED = "chunk bigint, doc_ids array<bigint>, doc_lengths binary, ids binary, n_links binary, ends binary, link_ids binary"


def _pack(docs: pa.Table, segments: pa.Table, kind: str) -> pa.Table:
    """One row for a chunk: its documents, and the alignments of its segments in the order of their numbers."""
    segments = segments.sort_by("bucket")

    def column(name: str, kind: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(unsqueezed(x, kind) for x in segments.column(name).to_pylist())])

    found = Alignments(column("n_links", "<i4"), np.frombuffer(b"".join(map(unzipped, segments.column("ends").to_pylist())), np.uint8), column("link_ids", kind))
    at = np.argsort(unsqueezed(docs.column("places")[0].as_py()))  # where each number stands
    both = np.empty(len(found.a) + len(found.b), kind)
    n_a, n_b, starts = found.n_a[at], found.n_b[at], np.cumsum((found.n_a + found.n_b)[at])
    both[spread(starts - n_a - n_b, n_a)] = found.a[spread((np.cumsum(found.n_a) - found.n_a)[at], n_a)]
    both[spread(starts - n_b, n_b)] = found.b[spread((np.cumsum(found.n_b) - found.n_b)[at], n_b)]
    ends = found.ends[spread(found.at_links[:-1][at], found.n_links[at])]
    columns = {"n_links": squeezed(found.n_links[at]), "ends": zipped(ends.tobytes()), "link_ids": squeezed(both, kind)}
    out = docs.select([x.split()[0] for x in _PACKED.split(", ")][:4])
    for name, data in columns.items():
        out = out.append_column(name, pa.array([data], pa.binary()))
    return out


class Chunk:
    """A packed chunk, read again."""

    def __init__(self, row: dict, kind: str) -> None:
        self.doc_ids, self.ids = row["doc_ids"], unsqueezed(row["ids"])
        self.segments = Alignments(unsqueezed(row["n_links"]), np.frombuffer(unzipped(row["ends"]), np.uint8), unsqueezed(row["link_ids"], kind))
        self.at = np.concatenate([[0], np.cumsum(unsqueezed(row["doc_lengths"]), dtype=np.int64)])
        failed = np.concatenate([np.zeros(1, np.int32), np.cumsum(self.segments.bad[self.ids], dtype=np.int32)])
        #: Documents that have segments, none of which is bad.
        self.usable = (self.at[1:] > self.at[:-1]) & (failed[self.at[1:]] == failed[self.at[:-1]])

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of ids in usable documents, in order, and how many of these hold each."""
        pairs, pair_of = np.unique(self.segments.codes(), return_inverse=True)
        first, n = self.segments.at_links[:-1], self.segments.n_links
        counts = np.zeros(len(pairs), np.int64)
        for k in np.flatnonzero(self.usable):
            own = np.unique(self.ids[self.at[k] : self.at[k + 1]])
            counts[np.unique(pair_of[spread(first[own], n[own])])] += 1
        return pairs[counts > 0], counts[counts > 0]

    def rows(self, codes: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The documents' rows, with the counts of at least all pairs in usable documents, in order of their codes."""
        s, own = self.segments, self.segments.codes()
        place = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
        known = codes[place] == own if len(codes) else np.zeros(len(own), bool)  # others stand in no usable document

        def over_links(values: np.ndarray) -> np.ndarray:
            total = np.zeros(len(own) + 1, np.int64)
            if len(codes):
                np.cumsum(np.where(known, values[place], 0), out=total[1:])
            return total[s.at_links[1:]] - total[s.at_links[:-1]]

        values = np.array([s.n_a, s.n_b, s.n_groups, s.n_links, over_links(best), over_links(counts)], np.int64)
        groups, names, n = s.group_texts(), [x.split()[0] for x in _ROWS.split(", ")], len(self.doc_ids)
        for i in range(0, n, 64):
            j = min(i + 64, n)
            own, at, usable = self.ids[self.at[i] : self.at[j]], self.at[i : j + 1] - self.at[i], self.usable[i:j]
            total = np.concatenate([np.zeros((len(values), 1), np.int64), np.cumsum(values[:, own], axis=1)], axis=1)
            sums = np.where(usable, total[:, at[1:]] - total[:, at[:-1]], 0)
            texts = [";".join(groups[own[at[k] : at[k + 1]]].tolist()) if usable[k] else "" for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([pa.array(self.doc_ids[i:j], pa.int64()), *map(pa.array, sums), pa.array(texts, pa.string())], names)


_ROWS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 24, buckets: int = 4096, most_sent: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """The documents, and the pairs of ids with their counts.

    Documents: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, for every row of docs. The text with a
    blank before it is encoded by the byte-level tokenizer file path_a (strings of special tokens are plain text), the
    text by the sentencepiece model path_b, which puts that blank there itself. Byte offsets where tokens of both end
    cut the tokens into groups, written as `a1,a2|b1;a3|b2,b3`. A link is two tokens with bytes in common. n_best
    counts the links whose pair of ids stands in as many documents as any pair of that first id (ties are all best),
    count_sum adds up the pairs' document counts over all links. Texts that are null or empty, or that either
    tokenizer doesn't give back byte by byte, have zeros, empty groups, and count in no pair. Repeated rows are
    documents of their own, as are rows with null ids.

    Pairs: a, b, n (documents) and best.

    Texts are cut before runs of white space, where split_before() shows that no token of either side goes across. The
    documents of a task make chunks of chunk_chars characters (a longer text is one alone), whose distinct segments are
    numbered and shuffled by buckets of a hash, so that a segment comes at most once from each chunk, however often it
    stands there. Those of all chunks are aligned once, bucket by bucket; the alignments go back to their chunks, which
    are written to the shared folder, a row each. From these rows the pairs are counted (summed up in each chunk before they are shuffled) and the documents
    composed. Up to most_sent pairs (16 bytes each) are sent to all tasks; more are joined to the chunks that hold
    them. The chunks and pairs stay in the shared folder, as the result reads them.
    """
    spark = docs.sparkSession
    kind = id_kind(*tokenizers(path_a, path_b))
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    chunked(docs, path_a, path_b, chunk_chars, buckets, id_col, text_col).write.parquet(f"{folder}/texts")
    texts, known = (spark.read.parquet(f"{folder}/texts") for _ in range(2))
    texts = texts.where(F.col("bucket").isNull()).select("chunk", "doc_ids", "doc_lengths", "ids", "places")
    parts = align_segments(known.where(F.col("bucket").isNotNull()), path_a, path_b)
    texts.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(lambda d, x: _pack(d, x, kind), _PACKED).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes, n = Chunk(row, kind).pair_counts()
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(codes), pa.int64()), pa.array(codes), pa.array(n)], ["chunk", "code", "n"])

    in_chunks = chunks.transform(in_arrow, counted, "chunk bigint, code bigint, n bigint")
    in_chunks.groupBy("code").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs").withColumn("a", F.shiftright("code", 32))
    pairs = pairs.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("a")))

    if spark.read.parquet(f"{folder}/pairs").count() <= most_sent:
        table = pairs.select("code", "n", "best").toArrow().sort_by("code")
        sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "n", "best")))

        def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    yield from Chunk(row, kind).rows(*sent.value)

        out = chunks.transform(in_arrow, composed, _ROWS)
    else:
        of_chunks = in_chunks.select("chunk", "code").join(pairs.select("code", "n", "best"), "code")

        def composed_with(chunk: pa.Table, own: pa.Table) -> pa.Table:
            own = own.sort_by("code")
            values = (own.column(c).to_numpy() for c in ("code", "n", "best"))
            return pa.Table.from_batches(list(Chunk(chunk.to_pylist()[0], kind).rows(*values)))

        out = chunks.groupBy("chunk").cogroup(of_chunks.groupBy("chunk")).applyInArrow(composed_with, _ROWS)
    return out.withColumnRenamed("doc_id", id_col), pairs.select("a", F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n", "best")
