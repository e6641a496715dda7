"""SimHash near-duplicates: fingerprints of word shingles, linked by a grid join over segment popcounts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import broadcast_up_to, checkpoint, close_pairs, in_arrow, in_blocks, slices, whole_groups
from visgauge.llm.components import connected_components
from visgauge.llm.shared import sharing_pairs

BITS = 64
LOW = 0x5555555555555555
#: Row i: the bits of byte value i, lowest first.
BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of a text, each hashed by XXH64; 0 for null and for texts without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: 1 - words or None].tolist()
    h = xxhash.xxh64_digest
    digests = np.frombuffer(b"".join([h(joined[i:j], seed) for i, j in zip(begins, ends[words - 1 :].tolist(), strict=True)]), np.uint8).reshape(-1, 8)
    bits = 0
    for k in range(8):  # digests are big-endian: column 0 holds the highest byte
        ones = np.bincount(digests[:, k], minlength=256) @ BYTE_BITS
        for b in np.flatnonzero(2 * ones > len(digests)).tolist():
            bits |= 1 << (8 * (7 - k) + b)
    return bits


def _fingerprints(words: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(x.as_py(), words, seed) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """id, fp (the 64 bits as bigint) for every row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(in_arrow, _fingerprints(words, seed), "id bigint, fp bigint")


def _forest(prints: np.ndarray, codes: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs of places that join each component within radius of a block, by a search that leaves out what it reached."""
    us, vs = [], []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(codes[rest] ^ codes[x]) <= radius
            near[near] = np.bitwise_count(prints[rest[near]] ^ prints[x]) <= radius
            found = rest[near]
            if len(found):
                us.append(np.full(len(found), x))
                vs.append(found)
                front.extend(found.tolist())
                rest = rest[~near]
    return us, vs


def _unary(prints: np.ndarray) -> np.ndarray:
    """The bit count of each segment of two bits, written in unary (0: 00, 1: 01, 2: 11)."""
    low = np.uint64(LOW)
    a, b = prints & low, (prints >> np.uint64(1)) & low
    return a | b | ((a & b) << np.uint64(1))


def _link_cells(radius: int, small: int = 48) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In each cell, first the Manhattan distance of the popcounts, then the exact Hamming distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["cell"]):
            prints = t.column("fp").to_numpy().view(np.uint64)
            codes = _unary(prints)
            ends = np.append(starts[1:], len(prints))
            few = ends - starts <= small
            us, vs = [], []
            for i, j in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
                found = _forest(prints[i:j], codes[i:j], radius)
                us += [x + i for x in found[0]]
                vs += [x + i for x in found[1]]
            kept = np.flatnonzero(np.repeat(few, ends - starts))
            sizes = (ends - starts)[few]
            if len(kept):
                for a, b in close_pairs(np.cumsum(sizes) - sizes, len(kept)):
                    a, b = kept[a], kept[b]
                    near = np.bitwise_count(codes[a] ^ codes[b]) <= radius
                    a, b = a[near], b[near]
                    near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
                    us.append(a[near])
                    vs.append(b[near])
            if us:
                node = t.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(x)]) for x in (us, vs)], ["u", "v"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_fingerprints(prints: DataFrame, radius: int = 4, exact_groups: int = 2, block_rows: int = 4096) -> DataFrame:
    """Links u, v between nodes that join all components of fingerprints with at most radius differing bits.

    prints: node bigint, fp bigint and tbl int; fingerprints are compared within their tbl. Each of 32 segments of two
    bits is mapped to its bit count, written in unary (0: 00, 1: 01, 2: 11), so that the Manhattan distance of two
    vectors of counts is the number of differing bits of their codes. It is never above the Hamming distance of the
    fingerprints. The segments form radius + exact_groups groups; two vectors within the radius differ in at most radius
    groups, so they are equal in exact_groups of them at least and share the grid cell of those coordinates. A cell travels
    as a hash of its coordinates; cells that share a hash add candidates, no links. Candidates beyond the radius by
    Manhattan distance go, and the rest is compared exactly. The range of a cell is one value of each coordinate: wider
    ranges would need the cells around as well, for a radius of 4 in five groups 20 cells to stand in and 220 to look at
    for each fingerprint, of 19 bits, where these are 15 of 16 bits. More exact_groups make smaller cells and more of them, for
    larger inputs. Cells of few rows give all their links, larger ones as many as join their components.
    """
    groups = np.array_split(np.arange(BITS // 2), radius + exact_groups)
    masks = [_signed(sum(3 << (2 * int(s)) for g in some for s in g)) for some in combinations(groups, exact_groups)]
    a, b = F.col("fp").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(LOW))
    coded = prints.select("tbl", "node", "fp", a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1)).alias("code"))
    coordinates = F.array(*[F.xxhash64("tbl", F.lit(k), F.col("code").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    blocks = in_blocks(coded.select("node", "fp", F.explode(coordinates).alias("cell")), ["cell"], F.col("node"), block_rows)
    group = F.when(F.col("bi") == F.col("bj"), F.col("cell")).otherwise(F.xxhash64("cell", "bi", "bj"))
    rows = blocks.select(group.alias("cell"), "node", "fp").repartition("cell").sortWithinPartitions("cell")
    return rows.transform(in_arrow, _link_cells(radius), "u bigint, v bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of docs: id_col, fp bigint, component_id (the smallest id reachable over links within radius).

    Fingerprints are linked, not documents: copies meet in one aggregation and never form pairs. Null texts and texts
    without words have fingerprint 0, linked like any other. Rows with a null id are kept and are linked, but are never
    the smallest; a component of null ids only has a null component_id. Repeated ids are rows of their own.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, words, seed))
    # numbered in the order of their smallest ids, so that the smallest node of a component is that of the smallest id
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least")).orderBy(F.asc_nulls_last("least"), "fp")
    distinct = checkpoint(distinct.select("fp", "least", F.monotonically_increasing_id().alias("node")))
    roots = connected_components(link_fingerprints(distinct.select(F.lit(0).alias("tbl"), "node", "fp"), radius))
    named = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    of = named.join(distinct.select(F.col("node").alias("root"), F.col("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _word_prints(tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each text: two digests of its words in order, and a fingerprint of its set of words for each seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, prints = [], []
            for x in b.column(1):
                words = (x.as_py() or "").encode().lower().split()
                joined = b" ".join(words)
                keys.append((xxhash.xxh3_64_intdigest(joined), xxhash.xxh64_intdigest(joined)))
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, set(words)), np.uint64)
                for t in range(tables):
                    mixed = (h ^ np.uint64(0x9E3779B97F4A7C15 * (t + 1) % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
                    mixed = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)).view(np.uint8).reshape(-1, 8)
                    ones = np.array([np.bincount(mixed[:, k], minlength=256) @ BYTE_BITS for k in range(8)]).ravel()
                    prints.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]))
            k = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(prints) + 1, tables, dtype=np.int32)), pa.array(np.array(prints, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k[:, 0]), pa.array(k[:, 1]), lists], ["row", "k1", "k2", "prints"])

    return run


def _shingle_sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = []
            for x in b.column(1):
                w = (x.as_py() or "").encode().lower().split()
                sets.append(np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))], np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["row", "shingles"])

    return run


def _similar(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(common >= similarity * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _few_of_each(links: DataFrame, most: int = 8) -> DataFrame:
    """The distinct pairs u < v of links that one of the two nodes chose: each chooses at most so many partners, of those
    of a remainder of their hashes the one with most links to it."""
    pairs = links.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = pairs.select("n", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("n", "e.*")
    chosen = ends.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(most)).alias("k")).agg(F.max(F.struct("n", "v"))["v"].alias("v"))
    return chosen.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _joined_further(roots: DataFrame, pairs: DataFrame, texts: DataFrame, words: int, similarity: float, large: int = 64) -> DataFrame:
    """roots, with what else is similar to groups of more than `large` rows: of each of these about so many rows, and all
    other rows of pairs, go through sharing_pairs. What is joined here forms no pairs with the whole group later."""
    sizes = checkpoint(roots.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large))
    if sizes.isEmpty():
        return roots
    left_out = roots.join(broadcast_up_to(sizes, F.lit(16)), "root").where(F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / large)) != 0).select(F.col("node").alias("row"))
    tried = checkpoint(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct().join(left_out, "row", "left_anti"))
    some = texts.join(broadcast_up_to(tried, F.lit(16)), "row", "left_semi")
    more = checkpoint(sharing_pairs(some, roots, words, similarity))
    return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(_verified(more, texts, words, similarity)))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs u, v whose texts reach the similarity, stored, so that one Python function at a time runs beside the sets."""
    asked = checkpoint(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct())
    sets = texts.join(broadcast_up_to(asked, F.lit(16)), "row", "left_semi").transform(in_arrow, _shingle_sets(words), "row bigint, shingles binary")
    left, right = (sets.select(F.col("row").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("u", "v"))
    return checkpoint(pairs.join(left, "u").join(right, "v").select("u", "v", "of_u", "of_v").transform(in_arrow, _similar(similarity), "u bigint, v bigint"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tables: int = 6, radius: int = 5) -> DataFrame:
    """The rows of docs less all but one row, that of the smallest id, of each group of near-duplicates.

    Two texts are near-duplicates if the sets of their shingles of `words` words have a Jaccard similarity of at least
    similarity; groups are connected components. First candidates are pairs whose fingerprints of single words are
    within radius for one of several seeds, a few of each text, which join most of a group at once; a part of each large
    group then joins more. Prefix filtering gives all other pairs that can reach the similarity, less those of one group. Every candidate is compared exactly, so no pair is
    missed. Texts with the same words in the same order form one class first and never form pairs. Null texts and texts
    without words are copies of each other. Null ids count as greater than all others; equal ids: any one row stays.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    texts = rows.select("row", F.col("doc")[text_col].cast("string").alias("text"))
    ids = rows.select("row", F.coalesce(F.col("doc")[id_col].cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    hashed = texts.transform(in_arrow, _word_prints(tables), "row bigint, k1 bigint, k2 bigint, prints array<bigint>").join(ids, "row")
    classes = checkpoint(hashed.groupBy("k1", "k2").agg(F.min(F.struct("id", "row")).alias("least"), F.first("prints").alias("prints")).select("least.*", "prints"))
    prints = classes.select(F.col("row").alias("node"), F.posexplode("prints").alias("tbl", "fp"))
    pairs = checkpoint(_few_of_each(link_fingerprints(prints, radius)))
    roots = checkpoint(connected_components(_verified(pairs, texts, words, similarity)))
    roots = checkpoint(_joined_further(roots, pairs, texts, words, similarity))
    copies = checkpoint(ids.join(classes.select("row"), "row", "left_anti").select("row"))
    firsts = texts.join(broadcast_up_to(copies, F.lit(16)), "row", "left_anti")
    more = checkpoint(sharing_pairs(firsts, roots, words, similarity))
    links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(_verified(more, texts, words, similarity))
    roots = connected_components(links)
    named = classes.join(roots.withColumnRenamed("node", "row"), "row", "left").select("id", "row", F.coalesce("root", "row").alias("root"))
    stays = checkpoint(named.groupBy("root").agg(F.min(F.struct("id", "row")).alias("least")).select(F.col("least.row").alias("row")))
    gone = checkpoint(ids.join(stays, "row", "left_anti").select("row"))
    return rows.join(broadcast_up_to(gone, F.lit(16)), "row", "left_anti").select("doc.*")
