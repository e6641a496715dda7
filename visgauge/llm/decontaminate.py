"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact shingle similarity."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import checkpoint, in_arrow

#: Where the blocks of a fingerprint of 64 bits begin and end.
CUTS = (0, 13, 26, 39, 52, 64)
#: Words of which a fingerprint's features are made.
FEATURE = 2
#: Fingerprints that share one set of tables: one bit of a table's value each.
TOGETHER = 64
#: All marks of ASCII become blanks; letters beyond ASCII stay as they are.
_TO_BLANK = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
#: Scripts that are written without blanks: each of their characters is a word. Their marks, and those of the general punctuation, are none.
_UNSPACED = re.compile("([฀-໿က-႟ក-៿ぁ-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff])")
_WIDE_MARKS = re.compile("[ -⁯　-〠・！-／：-＠［-｀｛-･]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without marks; each character of a script without blanks is a word."""
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", _WIDE_MARKS.sub(" ", text))
    return text.encode().translate(_TO_BLANK).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, in order, from the hashes of the words."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def fingerprints(features: np.ndarray, widths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each width, the SimHash of each window of so many features: a bit is 1 if set in over half of them.

    The counts of bits are summed over runs of 1, 2, 4, ... features, of which each window is made.
    """
    wanted = sorted(w for w in set(widths) if w <= len(features))
    most = max(wanted, default=0)
    runs = [np.unpackbits(features.view(np.uint8)).reshape(-1, 64).astype(np.uint8 if most < 256 else np.uint32, copy=False)]
    while 2 << (len(runs) - 1) <= most:
        runs.append(runs[-1][: -(1 << (len(runs) - 1))] + runs[-1][1 << (len(runs) - 1) :])
    for w in wanted:
        n, at, ones = len(features) - w + 1, 0, None
        for k in range(w.bit_length() - 1, -1, -1):
            if w >> k & 1:
                part = runs[k][at : at + n]
                ones = part if ones is None else ones + part
                at += 1 << k
        yield w, np.packbits((ones > w // 2).ravel()).view(np.uint64)


def window_size(words: int) -> int:
    """The size of the windows for an item of so many words: the largest up to it of 1 to 8, then each a fifth more."""
    size = min(words, 8)
    while size >= 8 and size + size // 5 <= words:
        size += size // 5
    return size


def _width(size: int) -> int:
    """The features of a window of so many words."""
    return max(size - FEATURE + 1, 1)


@dataclass(frozen=True)
class Tables:
    """Up to 64 fingerprints of windows of one size: for each block and value of it, those that are near in it."""

    prints: np.ndarray
    #: For each fingerprint, its item's place in Index.items and the word of the item at which its window begins.
    item: list[int]
    offset: list[int]
    near: list[np.ndarray]


@dataclass(frozen=True)
class Index:
    #: Of each item: id, number of words, counts of its shingles.
    items: list[tuple[int, int, Counter]]
    sizes: dict[int, list[Tables]]


def _blocks(prints: np.ndarray) -> list[np.ndarray]:
    return [((prints >> np.uint64(i)) & np.uint64((1 << (j - i)) - 1)).astype(np.intp) for i, j in pairwise(CUTS)]


def _tables(prints: np.ndarray, item: list[int], offset: list[int], radius: int) -> Tables:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(prints) <= 8 * np.dtype(k).itemsize)
    near = []
    for (i, j), own in zip(pairwise(CUTS), _blocks(prints), strict=True):
        values = np.arange(1 << (j - i), dtype=np.uint64)
        near.append(np.zeros(len(values), kind))
        for k, value in enumerate(own):
            near[-1] |= (np.bitwise_count(values ^ np.uint64(value)) <= radius // (len(CUTS) - 2)).astype(kind) << kind(k)
    return Tables(prints, item, offset, near)


@lru_cache(maxsize=1)
def build_index(found: tuple[tuple[int, str], ...], shingle: int, radius: int) -> Index:
    """The index of the items; a worker keeps it from one task to the next.

    An item's windows are those at its begin, its middle and its end, so that words lost at its edges don't count. Two
    fingerprints within radius differ in at most radius // 4 bits in two of the five blocks at least: if four blocks
    had more, they would differ in 4 * (radius // 4 + 1) bits, which is above radius.
    """
    items: list[tuple[int, int, Counter]] = []
    sizes: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    for item, text in found:
        h = word_hashes(words_of(text))
        if len(h):
            size = window_size(len(h))
            ((_, prints),) = fingerprints(shingles_of(h, min(FEATURE, size)), [_width(size)])
            for at in {0, (len(h) - size) // 2, len(h) - size}:
                sizes[size][len(items), at] = int(prints[at])
            items.append((item, len(h), Counter(shingles_of(h, min(shingle, len(h))).tolist())))
    tables: dict[int, list[Tables]] = {}
    for size, own in sorted(sizes.items()):
        keys = sorted(own)
        parts = [keys[i : i + TOGETHER] for i in range(0, len(keys), TOGETHER)]
        tables[size] = [_tables(np.array([own[k] for k in part], np.uint64), [i for i, _ in part], [at for _, at in part], radius) for part in parts]
    return Index(items, tables)


def _near(prints: np.ndarray, blocks: list[np.ndarray], t: Tables, radius: int) -> Iterator[tuple[int, int, int]]:
    """Row, fingerprint of t and distance of the pairs within radius that the blocks point out."""
    once, twice = (np.zeros(len(prints), t.near[0].dtype) for _ in range(2))
    for near, own in zip(t.near, blocks, strict=True):
        here = near.take(own, mode="clip")
        twice |= once & here
        once |= here
    hit = np.flatnonzero(twice)
    if len(hit):
        apart = np.bitwise_count(prints[hit][:, None] ^ t.prints)
        rows, which = np.nonzero(apart <= radius)
        yield from zip(hit[rows].tolist(), which.tolist(), apart[rows, which].tolist(), strict=True)


def near_windows(texts: list[np.ndarray], index: Index, radius: int, piece: int = 4096) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For texts given as hashes of their words: for each text and item, the places at which the item would begin in the
    text by a window within radius, and the distances there. Texts stand one behind the other, so that many short ones
    are fingerprinted at once; windows across an end are left out, and a text of fewer words is one window."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    h = np.concatenate([np.zeros(0, np.uint64), *texts])
    ends = np.cumsum([0, *map(len, texts)])
    longest = max(index.sizes, default=0)
    for low in range(0, len(h), piece):
        part = h[low : low + piece + longest - 1]
        for feature in sorted({min(FEATURE, size) for size in index.sizes}):
            sizes = {_width(s): s for s in index.sizes if min(FEATURE, s) == feature}
            for width, prints in fingerprints(shingles_of(part, feature), sizes):
                prints = prints[:piece]
                blocks = _blocks(prints)
                for t in index.sizes[sizes[width]]:
                    for row, k, d in _near(prints, blocks, t, radius):
                        text = int(np.searchsorted(ends, low + row, "right")) - 1
                        if low + row + sizes[width] <= ends[text + 1]:
                            found[text, t.item[k]].append((low + row - int(ends[text]) - t.offset[k], d))
    for text, own in enumerate(texts):
        if 0 < len(own) < longest:
            ((_, prints),) = fingerprints(shingles_of(own, min(FEATURE, len(own))), [_width(len(own))])
            for size in index.sizes:
                if len(own) < size <= 2 * len(own):
                    for t in index.sizes[size]:
                        for _, k, d in _near(prints, _blocks(prints), t, radius):
                            found[text, t.item[k]].append((0, d))
    return found


def matches(texts: Iterable[str | None], index: Index, shingle: int, radius: int, similarity: float, words: int = 1 << 15) -> Iterator[list[tuple[int, float, int, int]]]:
    """For each text, (item, similarity, first word, Hamming distance) of the best window for each item found in it."""
    held: list[np.ndarray] = []

    def done() -> Iterator[list[tuple[int, float, int, int]]]:
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in held]
        for (k, i), places in near_windows(held, index, radius).items():
            best = best_window(held[k], index.items[i], {p for p, _ in places}, shingle, similarity)
            if best:
                out[k].append((index.items[i][0], *best, min(d for _, d in places)))
        held.clear()
        return map(sorted, out)

    n = 0
    for text in texts:
        held.append(word_hashes(words_of(text)))
        n += len(held[-1])
        if n >= words or len(held) >= 512:
            yield from done()
            n = 0
    yield from done()


def best_window(h: np.ndarray, item: tuple[int, int, Counter], places: set[int], shingle: int, similarity: float) -> tuple[float, int] | None:
    """Similarity and first word of the best window of the item's size around places, if it reaches the similarity."""
    _, words, counts = item
    k = min(shingle, words)
    width, slack = min(words - k + 1, len(h) - k + 1), 1 + words // 4
    if width < similarity * counts.total():
        return None
    last = len(h) - k + 1 - width
    best: tuple[float, int] | None = None
    low = high = -1
    local: list[int] = []
    for start in sorted({s for place in places for s in range(max(place - slack, 0), min(place + slack, last) + 1)}):
        if start + width > high:  # shingles are made for a stretch of the text at a time
            low, high = start, start + width + 4096
            local = shingles_of(h[low : high + k - 1], k).tolist()
        own = Counter(local[start - low : start - low + width])
        common = (own & counts).total()
        s = common / (width + counts.total() - common)
        if s >= similarity and (best is None or s > best[0]):
            best = s, start
            if s == 1:
                break
    return best


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shingle: int = 5, similarity: float = 0.8, radius: int = 11, items_at_once: int = 1000,
) -> DataFrame:
    """id_col, item_id, similarity, first_word, hamming: the best window of each document for each item that it holds.

    Every window of a text is fingerprinted, at sizes of up to a fifth below an item's number of words, from runs of two
    words. Those within radius of a window at an item's begin, middle or end, found through the Hamming blocks, are
    candidates; around each, the windows that have the number of words of the item are compared exactly. The similarity
    is that of the multisets of shingles (minima over maxima of the counts), and the first of equally similar windows
    counts. Items that are null or without words match nothing, and so do such texts; shorter texts than an item are one
    window. Repeated documents are rows of their own, rows of one item id are one item. Items are sent to all tasks,
    items_at_once at a time, which bounds the driver and the tables of a task: a larger benchmark takes more passes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for own in _item_slices(benchmark, item_col, item_text, items_at_once):
        part = rows.transform(in_arrow, _search(own, shingle, radius, similarity), "id bigint, item_id bigint, similarity double, first_word int, hamming int")
        found = part if found is None else found.unionByName(part)
    best = found if found is not None else rows.limit(0).transform(in_arrow, _search((), shingle, radius, similarity), "id bigint, item_id bigint, similarity double, first_word int, hamming int")
    return best.withColumnRenamed("id", id_col)


def _item_slices(benchmark: DataFrame, item_col: str, item_text: str, items_at_once: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items that are not null, each once, so many at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    slices = -(-items.count() // items_at_once)
    for k in range(slices):
        yield tuple((r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k).distinct().orderBy("item", "text").collect())


def _search(items: tuple[tuple[int, str], ...], shingle: int, radius: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(items, shingle, radius)
        for b in batches:
            found = matches((x.as_py() for x in b.column(1)), index, shingle, radius, similarity)
            rows = [(doc, *m) for doc, own in zip(b.column(0).to_pylist(), found, strict=True) for m in own]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "item_id", "similarity", "first_word", "hamming"])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shingle: int = 5, similarity: float = 0.8, radius: int = 11, items_at_once: int = 1000,
) -> DataFrame:
    """The rows of docs in which no item was found, by the text of each row alone: ids may be null or repeated. What a
    pass leaves is stored before the next one, so that a task holds the tables of one pass, in one Python worker."""
    for k, own in enumerate(_item_slices(benchmark, item_col, item_text, items_at_once)):
        docs = checkpoint(docs) if k else docs
        rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*docs.columns).alias("doc"))
        docs = rows.transform(in_arrow, _clean(own, shingle, radius, similarity), rows.schema).select("doc.*")
    return docs


def _clean(items: tuple[tuple[int, str], ...], shingle: int, radius: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(items, shingle, radius)
        for b in batches:
            yield b.filter(pa.array([not own for own in matches((x.as_py() for x in b.column(0)), index, shingle, radius, similarity)], pa.bool_()))

    return run
