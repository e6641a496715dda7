"""One JSON array of any size, read by byte ranges that many tasks share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where Spark cuts a file into rows: any sign that is frequent would do.
END = "}"
#: In a text that starts outside of strings: a string (the last one may be open), or a sign of structure.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{},]', re.S)
CLOSING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
ESCAPE = re.compile(r"\\.", re.S)


class BadArray(ValueError):
    """A file that isn't exactly one JSON array."""


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """The file's text in rows that END has ended, with file and range: the byte at which their part of the file starts."""
    rows = spark.read.option("lineSep", END).text(path)
    return rows.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("range"), "value")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, int]]:
    """file, range, text and number of rows for runs of rows of one range, in order."""
    for b in batches:
        files, starts, values = (b.column(k).to_pylist() for k in range(3))
        i = 0
        for j in range(1, len(files) + 1):
            if j == len(files) or (files[j], starts[j]) != (files[i], starts[i]):
                yield files[i], starts[i], END.join(values[i:j]) + END, j - i
                i = j


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: how many bytes it holds, whether it turns a string on or off, and by how much it goes deeper if it
    starts outside of strings (even) or inside of one (odd). Where it starts is not known yet."""
    seen: dict[tuple[str, int], list[int]] = {}
    for file, start, text, _ in _texts(batches):
        found = seen.setdefault((file, start), [0, 0, 0, 0])
        parts = ESCAPE.sub("  ", text).split('"')
        for side in (0, 1):
            outside = "".join(parts[side::2])
            found[2 + (side ^ found[1])] += outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
        found[0] += len(text.encode())
        found[1] ^= (len(parts) - 1) & 1
    if seen:
        columns = [[k[0] for k in seen], [k[1] for k in seen], *zip(*seen.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 5], strict=True)], ["file", "range", "bytes", "turns", "even", "odd"])


def _file_bytes(spark: SparkSession, file: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()


def _states(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """For each range: whether it starts inside of a string, at what depth, and whether its last row is the file's last
    and not ended by END. One row a range comes to the driver."""
    rows = _ranges(spark, path).mapInArrow(_summaries, "file string, range bigint, bytes bigint, turns bigint, even bigint, odd bigint").groupBy("file", "range").agg(F.max("bytes").alias("bytes"), F.max("turns").alias("turns"), F.max("even").alias("even"), F.max("odd").alias("odd"))
    states: dict[tuple[str, int], tuple[bool, int, bool]] = {}
    by_file: dict[str, list] = {}
    for r in rows.collect():
        by_file.setdefault(r.file, []).append(r)
    if not by_file:
        raise BadArray(f"{path} is empty")
    for file, found in by_file.items():
        inside, depth = False, 0
        found.sort(key=lambda r: r.range)
        open_end = sum(r.bytes for r in found) != _file_bytes(spark, file)
        for r in found:
            states[file, r.range] = (inside, depth, open_end and r is found[-1])
            depth += r.odd if inside else r.even
            inside ^= bool(r.turns)
        depth += open_end and not inside  # the END that the last row doesn't have was counted
        if inside or depth:
            raise BadArray(f"{file} ends before its array does, or closes more than it opens")
    return states


class _Cutter:
    """Cuts the text of one range into items. Its first piece ends an item of the ranges before, its last one goes on in
    those behind; each piece is known by the signs on its left and right, empty where it goes on."""

    def __init__(self, inside: bool, depth: int) -> None:
        self.inside, self.depth, self.left, self.held = inside, depth, "", []

    def pieces(self, text: str, file: str) -> Iterator[tuple[str, str, str]]:
        start = at = 0
        if self.inside:
            closed = CLOSING.match(text)
            at, self.inside = (closed.end(), False) if closed else (len(text), True)
        if not self.inside:
            for m in TOKEN.finditer(text, at):
                sign = text[m.start()]
                if sign == '"':
                    self.inside = not m[1]
                elif sign == ",":
                    if self.depth == 1:
                        yield self._ended(text[start : m.start()], ",")
                        start = m.end()
                elif sign in "[{":
                    if self.depth == 0:
                        before = "".join([*self.held, text[start : m.start()]])
                        if sign != "[" or before.strip() or self.left:
                            raise BadArray(f"{file} is no JSON array, or goes on behind it")
                        self.left, self.held, start = "[", [], m.end()
                    self.depth += 1
                else:
                    self.depth -= 1
                    if self.depth == 0:
                        if sign != "]":
                            raise BadArray(f"{file} closes its array with {sign}")
                        yield self._ended(text[start : m.start()], "]")
                        start = m.end()
        self.held.append(text[start:])

    def _ended(self, piece: str, sign: str) -> tuple[str, str, str]:
        whole, left = "".join([*self.held, piece]), self.left
        self.held, self.left = [], sign
        return left, whole, sign


_PIECES = "file string, range bigint, place int, `left` string, value string, `right` string"


def _pieces(spark: SparkSession, path: str, states: dict[tuple[str, int], tuple[bool, int, bool]]) -> DataFrame:
    sent = spark.sparkContext.broadcast(states)
    names = ["file", "range", "place", "left", "value", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, place, open_end = None, None, 0, False
        rows: list[tuple] = []

        def out(least: int) -> Iterator[pa.RecordBatch]:
            if len(rows) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 3], strict=True)], names)
                rows.clear()

        def finish() -> None:
            rest = "".join(cutter.held)
            if open_end:
                rest = rest.removesuffix(END)
            if cutter.depth == 0 and cutter.left == "]" and rest.strip():
                raise BadArray(f"{key[0]} goes on behind its array")
            rows.append((*key, place, cutter.left, rest, ""))

        late: tuple[str, str] | None = None
        for file, start, text, _ in _texts(batches):
            if (file, start) != key:
                if cutter is not None:
                    finish()
                key, place = (file, start), 0
                inside, depth, open_end = sent.value[key]
                cutter = _Cutter(inside, depth)
            if open_end:  # the last END of the last range isn't in the file: it is held back until more follows
                text, late = (END if late == key else "") + text[: -len(END)], key
            for left, value, right in cutter.pieces(text, file):
                rows.append((file, start, place, left, value, right))
                place += 1
                yield from out(1024)
        if cutter is not None:
            finish()
        if rows:
            yield from out(1)

    return _ranges(spark, path).mapInArrow(run, _PIECES)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of the JSON array that each file of path is, by schema; the order of rows is not that of the file.

    A file may be one line. It is read by the byte ranges that Spark cuts it into. A first pass finds, for each range,
    what its signs come to whether or not it starts inside of a string; the ranges' true starts follow one from the
    other, a few numbers each on the driver. Then each range is cut at the commas of the outermost level. Items that go
    across ranges are put together from their pieces, a few for each range, found by another pass. A text that is no
    array, ends too early or goes on behind the array, an empty item, and an item that isn't of the schema are errors.
    """
    pieces = _pieces(spark, path, _states(spark, path))
    whole = pieces.where("`left` <> '' and `right` <> ''").select("file", "left", "value", "right")
    cut = pieces.where("`left` = '' or `right` = ''")
    # a cut item starts with the last piece before it that has a sign on its left
    order = W.partitionBy("file").orderBy("range", "place")
    starts = F.last(F.when(F.col("left") != "", F.struct("range", "place")), ignorenulls=True).over(order)
    parts = cut.withColumn("_start", starts).groupBy("file", "_start").agg(F.array_sort(F.collect_list(F.struct("range", "place", "left", "value", "right"))).alias("_p"))
    joined = parts.select("file", F.col("_p")[0]["left"].alias("left"), F.array_join(F.transform("_p", lambda p: p["value"]), "").alias("value"), F.element_at("_p", -1)["right"].alias("right"))
    blank = F.col("value").rlike(r"^\s*$")
    outside = F.col("left").isin("", "]") | (F.col("right") == "")
    around = outside | ((F.col("left") == "[") & (F.col("right") == "]"))  # of the array, or all that is in it
    items = whole.unionByName(joined).where(~(blank & around))
    message = F.concat(F.lit("an empty item, or text outside of the array, in "), F.col("file"))
    checked = items.withColumn("value", F.when(blank | outside, F.raise_error(message)).otherwise(F.col("value")))
    one = F.concat(F.lit("["), F.col("value"), F.lit("]"))  # in an array, anything behind the item is an error too
    kind = T.ArrayType(T._parse_datatype_string(schema))
    return checked.select(F.from_json(one, kind, {"mode": "FAILFAST"})[0].alias("r")).select("r.*")
