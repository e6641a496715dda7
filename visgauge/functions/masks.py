"""Masks as run lengths, as Column expressions: never a pixel each.

A mask is an array<bigint> of edges: the places, in column order (top to bottom, then left to right), where background
and object take turns, background first. So the object's pixels are those from edges[0] up to edges[1], from edges[2] up
to edges[3], and so on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_EDGES = "cast(array() as array<bigint>)"


def edges(counts: Column) -> Column:
    """The edges of run lengths: pixels of background, object, background and so on."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(NO_EDGES).alias("edges"))
    step = lambda acc, n: F.struct((acc["at"] + n.cast("bigint")).alias("at"), F.array_append(acc["edges"], acc["at"] + n.cast("bigint")).alias("edges"))
    return F.aggregate(counts, start, step)["edges"]


def counts_of_text(text: Column) -> Column:
    """Run lengths of the published compressed form: numbers of five bits a character, the lowest first, each number from
    the fourth on less the one two places before it."""
    signs = F.filter(F.split(text, ""), lambda s: s != "")
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).alias("bits"), F.expr(NO_EDGES).alias("counts"))

    def step(acc: Column, sign: Column) -> Column:
        code = F.ascii(sign) - 48
        x, bits = acc["x"] + F.expr("bigint(1)") * F.call_function("shiftleft", code.bitwiseAND(F.lit(31)).cast("bigint"), acc["bits"]), acc["bits"] + 5
        signed = F.when(code.bitwiseAND(F.lit(16)) != 0, x - F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)).otherwise(x)
        n = F.size(acc["counts"])
        whole = F.when(n > 2, signed + F.try_element_at(acc["counts"], F.greatest(n - 1, F.lit(1)))).otherwise(signed)
        more = code.bitwiseAND(F.lit(32)) != 0
        done = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).alias("bits"), F.array_append(acc["counts"], whole).alias("counts"))
        return F.when(more, F.struct(x.alias("x"), bits.alias("bits"), acc["counts"].alias("counts"))).otherwise(done)

    return F.aggregate(signs, start, step)["counts"]


def polygon_runs(points: Column, height: Column, width: Column) -> Column:
    """Object runs, array<struct<a, b>>, of a polygon x1 y1 x2 y2 ...: one scan line through the centres of each column's
    pixels; those between the first and the second crossing, the third and the fourth and so on are inside."""
    n = (F.size(points) / 2).cast("int")
    xs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(points, 2 * i + 1))
    first = F.greatest(F.lit(0), F.ceil(F.array_min(xs) - 0.5).cast("int"))
    last = F.least(width.cast("int"), F.ceil(F.array_max(xs) - 0.5).cast("int")) - 1

    def column(x: Column) -> Column:
        at = x + 0.5

        def crossing(i: Column) -> Column:
            j = (i + 1) % n
            x1, y1, x2, y2 = (F.element_at(points, k) for k in (2 * i + 1, 2 * i + 2, 2 * j + 1, 2 * j + 2))
            return F.when((x1 <= at) != (x2 <= at), y1 + (at - x1) * (y2 - y1) / (x2 - x1))

        rows = F.transform(F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), crossing))), lambda y: F.greatest(F.lit(0).cast("bigint"), F.least(height.cast("bigint"), F.ceil(y - 0.5))))
        pairs = F.when(F.size(rows) > 1, F.sequence(F.lit(1), F.size(rows) - 1, F.lit(2))).otherwise(F.expr("cast(array() as array<int>)"))
        top = x.cast("bigint") * height.cast("bigint")
        return F.transform(pairs, lambda k: F.struct((top + F.element_at(rows, k)).alias("a"), (top + F.element_at(rows, k + 1)).alias("b")))

    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    return F.when((n >= 3) & (first <= last), F.flatten(F.transform(F.sequence(first, last), column))).otherwise(none)


def union_edges(runs: Column) -> Column:
    """The edges of the union of object runs in any order, overlaps included."""
    events = F.array_sort(F.flatten(F.transform(F.filter(runs, lambda r: r["b"] > r["a"]), lambda r: F.array(F.struct(r["a"].alias("at"), F.lit(0).alias("ends")), F.struct(r["b"].alias("at"), F.lit(1).alias("ends"))))))
    start = F.struct(F.lit(0).alias("depth"), F.expr(NO_EDGES).alias("edges"))

    def step(acc: Column, e: Column) -> Column:
        depth = acc["depth"] + F.when(e["ends"] == 1, -1).otherwise(1)
        flips = (acc["depth"] == 0) | (depth == 0)
        return F.struct(depth.alias("depth"), F.when(flips, F.array_append(acc["edges"], e["at"])).otherwise(acc["edges"]).alias("edges"))

    return F.aggregate(events, start, step)["edges"]


def polygon_edges(polygons: Column, height: Column, width: Column) -> Column:
    """The edges of one object that is made of several polygons."""
    return union_edges(F.flatten(F.transform(polygons, lambda p: polygon_runs(p, height, width))))


def mask_area(mask: Column) -> Column:
    """Pixels of the object."""
    state = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).cast("bigint").alias("sign"))
    pairs = F.slice(mask, F.lit(1), F.size(mask) - F.size(mask) % 2)  # a last edge without a partner starts nothing
    return F.aggregate(pairs, state, lambda acc, p: F.struct((acc["sum"] + acc["sign"] * p).alias("sum"), (-acc["sign"]).alias("sign")))["sum"]


def common_pixels(a: Column, b: Column) -> Column:
    """Pixels of both masks, by one pass over their edges in order."""

    def marked(mask: Column, first: bool) -> Column:
        even = F.size(mask) - F.size(mask) % 2
        turn = lambda i: F.when(i % 2 == 0, 1).otherwise(-1)
        none = F.lit(0)
        return F.transform(F.slice(mask, F.lit(1), even), lambda p, i: F.struct(p.alias("at"), (turn(i) if first else none).alias("a"), (none if first else turn(i)).alias("b")))

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.lit(0).alias("a"), F.lit(0).alias("b"), zero.alias("common"))

    def step(acc: Column, e: Column) -> Column:
        both = F.when((acc["a"] > 0) & (acc["b"] > 0), e["at"] - acc["at"]).otherwise(0)
        return F.struct(e["at"].alias("at"), (acc["a"] + e["a"]).alias("a"), (acc["b"] + e["b"]).alias("b"), (acc["common"] + both).alias("common"))

    return F.aggregate(F.array_sort(F.concat(marked(a, True), marked(b, False))), start, step)["common"]


def mask_overlap(found: Column, truth: Column, crowd: Column) -> Column:
    """Intersection over union of two masks; over the found mask alone where the truth is a crowd. 0 where that is empty."""
    common = common_pixels(found, truth).cast("double")
    whole = F.when(crowd, mask_area(found)).otherwise(mask_area(found) + mask_area(truth) - common)
    return F.when(whole > 0, common / whole).otherwise(F.lit(0.0))
