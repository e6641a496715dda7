"""Removal of long repeated strings by column-wise construction of the suffix order of many texts.

The construction follows Bauer, Cox and Rosone, "Lightweight algorithms for constructing and inverting the BWT of string
collections" (2013), with the longest common prefixes of Cox, Garofalo, Rosone and Sciortino (2016): in each round every
string of a collection gives one symbol, from its end to its begin, and the sorted order, the Burrows-Wheeler symbols and
the common prefixes of the round follow from those of the round before, which are read from and written to files.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import in_arrow

#: Bytes of the gram that is an anchor.
GRAM = 20
#: Symbol of the places before a text's begin and behind its end.
OUTSIDE = 256
LAST = np.iinfo(np.int64).max
_BASE, _BASE_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOLS, _OTHER_SYMBOLS = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _windowed(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f over each run of width values of x, by doubling."""
    size = 1
    out = x
    while 2 * size <= width:
        out = f(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return f(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass(frozen=True)
class _Part:
    """The anchors of a part of the texts: where they are in it, their grams, the ends of their texts, prefix sums."""

    low: int
    chosen: np.ndarray
    grams: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    bytes_: np.ndarray
    up: np.ndarray
    down: np.ndarray

    def hashes(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the strings from first to last, by polynomials over the symbols."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols[self.bytes_] * self.up[: len(self.bytes_)], dtype=np.uint64)])
        return _mix((sums[last] - sums[first]) * self.down[first])


def _parts(data: np.ndarray, ends: np.ndarray, length: int, piece: int) -> Iterator[_Part]:
    """Of each string of `length` bytes, the least gram by hash is an anchor, so equal strings have an anchor at the same
    place in them."""
    width = length - GRAM + 1
    begins = np.concatenate([[0], ends[:-1]])
    for at in range(0, len(data), piece):
        low, high = max(0, at - 2 * length), min(len(data), at + piece + 2 * length)
        part = data[low:high]
        if len(part) < length:
            continue
        up, down = _powers(piece + 4 * length + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOLS[part] * up[: len(part)], dtype=np.uint64)])
        n = len(part) - GRAM + 1
        h = _mix((sums[GRAM:] - sums[:n]) * down[:n]) | np.uint64(1)
        owner = np.searchsorted(ends, np.arange(low, low + n), "right")
        stop = ends[owner] - low
        h[np.arange(n) + GRAM > stop] = np.iinfo(np.uint64).max
        least = _windowed(np.minimum, h, width)
        least[np.arange(len(least)) + length > stop[: len(least)]] = 0
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(_windowed(np.maximum, padded, width)[:n] == h)
        chosen = chosen[(chosen + low >= at) & (chosen + low < at + piece)]
        yield _Part(low, chosen, h[chosen], np.maximum(begins[owner[chosen]] - low, 0), stop[chosen], part, up, down)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, piece: int = 1 << 19, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and two context hashes of the anchors of texts that stand one behind the other in data, but
    those of the grams in without. The context is what all strings of that length around the gram cover, as far as the
    text goes."""
    found = [np.zeros((4, 0), np.uint64)]
    for p in _parts(data, ends, length, piece):
        stays = slice(None) if without is None else ~np.isin(p.grams, without)
        chosen = p.chosen[stays]
        first, last = np.maximum(p.begin[stays], chosen - (length - GRAM)), np.minimum(chosen + length, p.stop[stays])
        shape = ((chosen - first) * 1024 + (last - first)).astype(np.uint64)
        one, two = (_mix(p.hashes(symbols, first, last) + shape) for symbols in (_SYMBOLS, _OTHER_SYMBOLS))
        found.append(np.stack([(chosen + p.low).astype(np.uint64), p.grams[stays], one, two >> np.uint64(32)]))
    places, grams, contexts, others = np.concatenate(found, axis=1)
    return places.astype(np.int64), grams, contexts, others


def strings_around(data: np.ndarray, ends: np.ndarray, length: int, grams: np.ndarray, piece: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and two hashes of all strings of `length` bytes that cover an anchor of some grams."""
    found = [np.zeros((3, 0), np.uint64)]
    for p in _parts(data, ends, length, piece):
        of = np.isin(p.grams, grams)
        first = (p.chosen[of][:, None] - np.arange(length - GRAM + 1)).ravel()
        good = (first >= np.repeat(p.begin[of], length - GRAM + 1)) & (first + length <= np.repeat(p.stop[of], length - GRAM + 1))
        first = np.unique(first[good])
        found.append(np.stack([(first + p.low).astype(np.uint64), *(p.hashes(symbols, first, first + length) for symbols in (_SYMBOLS, _OTHER_SYMBOLS))]))
    places, one, two = np.concatenate(found, axis=1)
    return places.astype(np.int64), one, two


def collection_matches(pieces: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each piece and each place l at which a string of `length` bytes can start, the least owner of that string.

    pieces: a row of bytes for each piece; only columns first to last of a row belong to its text. Column by column, from
    the last one, each piece inserts its symbol: the order of the suffixes that start there is the order of the round
    before, dealt stably by symbol, and two neighbours with the same symbol have one more byte in common than the least
    common prefix between them in the round before. The orders, Burrows-Wheeler symbols and prefixes of each round are
    written to a file that the next round reads from its begin to its end; two files take turns. Strings of different
    columns are never compared, as equal strings have their anchor at the same place, so each column keeps its own part
    of the transform.
    """
    n, columns = pieces.shape
    starts = columns - length + 1

    def symbols(j: int) -> np.ndarray:
        return np.where((j >= first) & (j < last), pieces[:, j], OUTSIDE).astype(np.uint16)

    order, common, symbol = np.arange(n, dtype=np.uint32), np.zeros(n + 1, np.uint8), symbols(columns - 1)
    out = np.full((n, starts), LAST)
    with tempfile.TemporaryFile() as before, tempfile.TemporaryFile() as after:
        for j in range(columns - 1, -1, -1):
            if j < columns - 1:
                before.seek(0)
                order, symbol, common = (np.frombuffer(before.read(size), kind) for size, kind in ((4 * n, np.uint32), (2 * n, np.uint16), (n + 1, np.uint8)))
            dealt = np.argsort(symbol, kind="stable")
            same = symbol[dealt[1:]] == symbol[dealt[:-1]]
            ranges = np.stack([dealt[:-1][same] + 1, dealt[1:][same] + 1], axis=1).ravel()
            longer = np.zeros(n + 1, np.uint8)
            if len(ranges):
                longer[1:n][same] = np.minimum(np.minimum.reduceat(common, ranges)[::2], length - 1) + 1
            order, common = order[dealt], longer
            if j:
                after.seek(0)
                for column in (order, symbols(j - 1)[order], common):
                    after.write(column.tobytes())
                before, after = after, before
            if j < starts:
                heads = np.flatnonzero(common[:n] < length)
                least = np.minimum.reduceat(owner[order], heads)
                out[order, j] = np.repeat(least, np.diff(np.append(heads, n)))
    column = np.arange(starts)
    out[(column < first[:, None]) | (column + length > last[:, None])] = LAST
    return out


def _pack(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(c.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpack(n: int, packed: bytes, *kinds: type) -> list[np.ndarray]:
    """n values of each kind."""
    raw = pa.decompress(packed, n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd", asbytes=True)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _slices(begins: np.ndarray, n: int) -> list[slice]:
    """The runs that begin at begins in n values."""
    return [slice(i, j) for i, j in zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True)] if len(begins) else []


#: An anchor's columns: gram hash, context hash, a second one of other symbols, id and row of its text, place in it.
_ANCHOR = (np.uint32, np.uint64, np.uint32, np.int64, np.int64, np.uint32)


def _emit(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket with the packed columns of its anchors."""
    order = np.argsort(bucket, kind="stable")
    begins = _runs(bucket[order])
    rows = [order[part] for part in _slices(begins, len(order))]
    packed = [_pack(*(c[r] for c in columns)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order[begins]].astype(np.int32)), pa.array([len(r) for r in rows], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "n", "packed"])


def _texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each value ends; nulls are empty."""
    values = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))


def _text_runs(b: pa.RecordBatch, text: int, chunk: int = 1 << 24) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts of some millions of bytes at a time, one text at least: first and end row, the bytes, where each text ends."""
    data, ends = _texts(b, text)
    low = 0
    while low < len(ends):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + chunk, "right")))
        yield low, high, data[base : ends[high - 1]], ends[low:high] - base
        low = high


def _owners(place: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each place, and the place in it."""
    owner = np.searchsorted(ends, place, "right")
    return owner, place - np.concatenate([[0], ends[:-1]])[owner]


def _find_anchors(length: int, buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for low, high, data, ends in _text_runs(b, 2):
                place, gram, context, other = anchors(data, ends, length, without=hot if len(hot) else None)
                if len(place):
                    owner, place = _owners(place, ends)
                    columns = [gram >> np.uint64(32), context, other, ids[low:high][owner], rows[low:high][owner], place]
                    yield _emit((gram % np.uint64(buckets)).astype(np.int64), [c.astype(k) for c, k in zip(columns, _ANCHOR, strict=True)])

    return run


def _count_grams(length: int):
    """Grams of the anchors of each batch, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, ends in _text_runs(b, 0):
                grams, n = np.unique(anchors(data, ends, length)[1], return_counts=True)
                several = n > 1  # what is once in each of its batches is no frequent gram
                yield pa.RecordBatch.from_arrays([pa.array(grams[several].view(np.int64)), pa.array(n[several])], ["gram", "n"])

    return run


def _hot_strings(length: int, hot: np.ndarray):
    """The strings around the anchors of frequent grams: two hashes, the text's order and row, the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for low, high, data, ends in _text_runs(b, 2, 1 << 20):
                place, one, two = strings_around(data, ends, length, hot)
                owner, place = _owners(place, ends)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one.view(np.int64), two.view(np.int64), ids[low:high][owner], rows[low:high][owner], place)], ["h1", "h2", "order", "row", "place"])

    return run


def frequent_grams(rows: DataFrame, length: int, most: int, one_of: int = 16) -> np.ndarray:
    """Grams of more than `most` anchors, sorted, as estimated on one of so many texts: whichever they are, the result is
    the same. At most one of `most` anchors can have such a gram, which bounds what the driver gets."""
    part = rows.where(F.pmod(F.xxhash64(F.lit("grams"), "row"), F.lit(one_of)) == 0).select("text")
    counts = part.transform(in_arrow, _count_grams(length), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["gram"] for r in counts.where(F.col("n") * one_of > most).collect()], np.int64).view(np.uint64))


def _bucket_anchors(group: pa.Table) -> list[np.ndarray]:
    parts = [_unpack(n, p, *_ANCHOR) for n, p in zip(group.column("n").to_pylist(), group.column("packed").to_pylist(), strict=True)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _repeated(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The anchors of a bucket whose gram is in several texts, by gram and context, and where each context begins."""
    columns = _bucket_anchors(group)
    order = np.argsort(columns[0], kind="stable")
    begins = _runs(columns[0][order])
    row = columns[4][order]
    several = np.minimum.reduceat(row, begins) < np.maximum.reduceat(row, begins)
    order = order[np.repeat(several, np.diff(np.append(begins, len(order))))]
    columns = [c[order] for c in columns]
    order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    changed = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)]) if len(order) else np.zeros(0, bool)
    return columns, np.flatnonzero(changed)


def _wanted(group: pa.Table) -> pa.Table:
    """For each text that holds the first of a context: the bucket, the contexts' numbers and their places."""
    columns, begins = _repeated(group)
    row, place = columns[4][begins], columns[5][begins]
    order = np.argsort(row, kind="stable")
    runs = _runs(row[order])
    parts = [np.sort(order[part]) for part in _slices(runs, len(order))]
    bucket = group.column("bucket")[0].as_py()
    return pa.table({
        "row": pa.array(row[order[runs]], pa.int64()), "bucket": pa.array([bucket] * len(parts), pa.int32()), "n": pa.array(list(map(len, parts)), pa.int32()),
        "slots": pa.array([p.astype(np.uint32).tobytes() for p in parts], pa.binary()), "places": pa.array([place[p].tobytes() for p in parts], pa.binary()),
    })


def _cut_pieces(length: int):
    """From each text, the pieces that were asked for: slot, columns that belong to the text, bytes."""
    left, columns = length - GRAM, 2 * length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, counts, packs = [], [], []
            for packed, size, wanted in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), np.uint8)
                for w in wanted:
                    slots, places = np.frombuffer(w["slots"], np.uint32), np.frombuffer(w["places"], np.uint32).astype(np.int64)
                    at = places[:, None] - left + np.arange(columns)
                    inside = (at >= 0) & (at < len(text))
                    found = np.where(inside, text[np.clip(at, 0, len(text) - 1)], 0).astype(np.uint8)
                    first, last = np.maximum(left - places, 0).astype(np.uint8), np.minimum(len(text) - places + left, columns).astype(np.uint8)
                    buckets.append(w["bucket"])
                    counts.append(len(slots))
                    packs.append(b"".join(x.tobytes() for x in (slots, first, last, found)))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(counts, pa.int32()), pa.array(packs, pa.binary())], ["bucket", "n", "pieces"])

    return run


def _judge(length: int):
    """Of a bucket's anchors and pieces: for each text the spans that strings of smaller ids cover."""
    left, width = length - GRAM, 2 * length - GRAM

    def run(group: pa.Table, cut: pa.Table) -> pa.Table:
        spans: tuple[list, list, list] = ([], [], [])
        if group.num_rows and cut.num_rows:
            columns, begins = _repeated(group)
            ids, rows, places = columns[3], columns[4], columns[5].astype(np.int64)
            context = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(ids))))
            pieces, first, last = np.zeros((len(begins), width), np.uint8), np.zeros(len(begins), np.uint8), np.zeros(len(begins), np.uint8)
            for n, raw in zip(cut.column("n").to_pylist(), cut.column("pieces").to_pylist(), strict=True):
                slots = np.frombuffer(raw, np.uint32, n)
                first[slots], last[slots] = np.frombuffer(raw, np.uint8, n, 4 * n), np.frombuffer(raw, np.uint8, n, 5 * n)
                pieces[slots] = np.frombuffer(raw, np.uint8, n * width, 6 * n).reshape(n, width)
            least = collection_matches(pieces, first, last, ids[begins], length)
            low, high = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
            for k in range(0, len(ids), 1 << 16):
                part = slice(k, k + (1 << 16))
                bad = least[context[part]] < ids[part][:, None]
                some = bad.any(axis=1)
                low[part] = np.where(some, bad.argmax(axis=1), 0)
                high[part] = np.where(some, bad.shape[1] - 1 - bad[:, ::-1].argmax(axis=1), -1)
            hit = np.flatnonzero(high >= 0)
            begin, end = places[hit] - left + low[hit], places[hit] - left + high[hit] + length
            order = np.lexsort((begin, rows[hit]))
            row, begin, end = rows[hit][order], begin[order], end[order]
            runs = _runs(row)
            parts = _slices(runs, len(row))
            spans = (row[runs].tolist(), [begin[p].astype(np.uint32).tobytes() for p in parts], [(end[p] - begin[p]).astype(np.uint8).tobytes() for p in parts])
        return pa.table({"row": pa.array(spans[0], pa.int64()), "begins": pa.array(spans[1], pa.binary()), "sizes": pa.array(spans[2], pa.binary())})

    return run


def _as_spans(length: int):
    """Rows of one place each as rows of packed spans, one for each text of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, place = (b.column(b.schema.names.index(c)).to_numpy() for c in ("row", "place"))
            order = np.argsort(row, kind="stable")
            row, place = row[order], place[order].astype(np.uint32)
            runs = _runs(row)
            parts = _slices(runs, len(row))
            sizes = [np.full(len(place[p]), length, np.uint8).tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(row[runs], pa.int64()), pa.array([place[p].tobytes() for p in parts], pa.binary()), pa.array(sizes, pa.binary())], ["row", "begins", "sizes"])

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
        packed = pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, raw)), pa.int64()), packed], ["row", "id", "size", "packed"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: tuple[list, list, list] = ([], [], [])
        for size, packed, spans in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            text = pa.decompress(packed, size, codec="zstd", asbytes=True)
            runs = 0
            if spans:
                begin = np.concatenate([np.frombuffer(s["begins"], np.uint32) for s in spans]).astype(np.int64)
                end = begin + np.concatenate([np.frombuffer(s["sizes"], np.uint8) for s in spans])
                depth = np.zeros(size + 1, np.int32)
                np.add.at(depth, begin, 1)
                np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                text = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for c, x in zip(counts, (size - len(text), runs, text), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(counts, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, anchors_in_bucket: int = 750_000, anchors_of_gram: int = 1_000_000, sampled: int = 16
) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (binary) for every row of docs.

    A byte of a text's UTF-8 goes if a string of `length` bytes that covers it also starts in a text with a smaller id.
    Strings are judged on the input. A null text is empty; a null id counts as greater than all others; texts with the
    same id don't count against each other. Shorter texts stay whole.

    Texts that share such a string share an anchor in it, a gram at the same place. Anchors are packed by bucket of
    their gram, and those in one text only go. Anchors with the same 20 bytes and the same 80 bytes
    around them, by hashes of 32 and 96 bits beside the bucket, have one piece of text fetched for all of them; the pieces
    of a bucket form a collection whose suffix order and common prefixes are built column by column, from their bytes;
    strings with the whole length in common stand side by side. The spans found go back to their texts.

    A gram of more than anchors_of_gram anchors, such as one of a sentence on every page, would fill one task. All strings
    around its anchors travel by two hashes of 64 bits instead; the least order of each is aggregated on the map side.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("order"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + 2 * total // (length - GRAM + 2) // anchors_in_bucket
    # both of these are read twice: the plan of each reader has the same exchange, so that it is made once
    hot = frequent_grams(rows, length, anchors_of_gram, sampled)
    by_bucket = rows.select("row", "order", "text").transform(in_arrow, _find_anchors(length, buckets, hot), "bucket int, n int, packed binary")
    texts = rows.select("row", "id", "text").transform(in_arrow, _compress, "row bigint, id bigint, size bigint, packed binary").where("row is not null").repartition("row")
    wanted = by_bucket.groupBy("bucket").applyInArrow(_wanted, "row bigint, bucket int, n int, slots binary, places binary")
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("bucket", "n", "slots", "places")).alias("wanted"))
    cut = texts.join(wanted, "row").select("id", "size", "packed", "wanted").transform(in_arrow, _cut_pieces(length), "bucket int, n int, pieces binary")
    judged = by_bucket.groupBy("bucket").cogroup(cut.groupBy("bucket")).applyInArrow(_judge(length), "row bigint, begins binary, sizes binary")
    if len(hot):
        around = rows.select("row", "order", "text").transform(in_arrow, _hot_strings(length, hot), "h1 bigint, h2 bigint, `order` bigint, row bigint, place bigint")
        least = around.groupBy("h1", "h2").agg(F.min("order").alias("first"), F.max("order").alias("last")).where("first < last").drop("last")
        again = around.join(least, ["h1", "h2"]).where("`order` > first")
        judged = judged.unionByName(again.transform(in_arrow, _as_spans(length), "row bigint, begins binary, sizes binary"))
    spans = judged.groupBy("row").agg(F.collect_list(F.struct("begins", "sizes")).alias("spans"))
    out = texts.join(spans, "row", "left").select("id", "size", "packed", "spans")
    out = out.transform(in_arrow, _remove, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id_col)
