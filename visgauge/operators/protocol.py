"""Detections of boxes or masks matched once: counts at one threshold, at all score thresholds, and by the COCO protocol."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from visgauge.functions.boxes import area
from visgauge.functions.masks import mask_overlap
from visgauge.functions.stats import f1, ratio
from visgauge.operators.matching import BOX, MASK, Shape, blocks, together
from visgauge.sources.folders import Steps

#: Overlap of a found shape with a true one, which may be a crowd.
Overlap = Callable[[Column, Column, Column], Column]
#: Areas by name, both ends included; fixed values of the protocol.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
#: IoU thresholds; fixed values of the protocol.
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
#: Detections of an image and category that count; fixed values of the protocol.
LIMITS = (1, 10, 100)


def box_overlap(found: Column, truth: Column, crowd: Column) -> Column:
    """Intersection over union of two boxes by corners; over the found box alone where the truth is a crowd."""
    common = F.greatest(F.least(found[2], truth[2]) - F.greatest(found[0], truth[0]), F.lit(0.0)) * F.greatest(F.least(found[3], truth[3]) - F.greatest(found[1], truth[1]), F.lit(0.0))
    whole = F.when(crowd, area(found)).otherwise(area(found) + area(truth) - common)
    return F.when((whole > 0) & found.isNotNull() & truth.isNotNull(), common / whole).otherwise(F.lit(0.0))


def overlaps(truth: DataFrame, found: DataFrame, keys: list[str], overlap: Overlap, least: float) -> DataFrame:
    """keys, det, score, gt, iou of all found and true shapes of equal keys that overlap by at least `least` (above 0).

    truth: keys, idx, shape, crowd; found: keys, idx, shape, score. Null shapes overlap with nothing."""
    t = truth.select(*keys, F.col("idx").alias("gt"), F.col("shape").alias("_t"), F.coalesce("crowd", F.lit(False)).alias("_crowd"))
    p = found.select(*keys, F.col("idx").alias("det"), F.col("shape").alias("_p"), "score")
    both = p.join(t, keys).withColumn("iou", overlap(F.col("_p"), F.col("_t"), F.col("_crowd")))
    return both.where((F.col("iou") >= least) & (F.col("iou") > 0)).drop("_t", "_p", "_crowd")


def hits(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, det, gt, score, iou of the pairs that greedy matching takes from overlaps(): detections by falling score, then
    by idx, each with the free truth that it overlaps most, the first of several. What is taken hangs on the detections
    before alone, so the matches at any higher score threshold are the first of these."""
    rows = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "det", (-F.col("iou")).alias("i"), "gt"))).alias("_c"))
    kind = rows.schema["_c"].dataType.simpleString()
    start = F.expr(f"cast(array() as {kind})")

    def take(acc: Column, c: Column) -> Column:
        return F.when(F.exists(acc, lambda h: (h["det"] == c["det"]) | (h["gt"] == c["gt"])), acc).otherwise(F.array_append(acc, c))

    taken = rows.select(*keys, F.explode(F.aggregate("_c", start, take)).alias("_h"))
    return taken.select(*keys, F.col("_h.det").alias("det"), F.col("_h.gt").alias("gt"), (-F.col("_h.o")).alias("score"), (-F.col("_h.i")).alias("iou"))


def _shape(overlap: Overlap | Shape) -> Shape:
    """How tasks compare shapes: of box_overlap and mask_overlap, or a Shape of one's own."""
    known = {box_overlap: BOX, mask_overlap: MASK}
    if isinstance(overlap, Shape):
        return overlap
    if overlap not in known:
        raise ValueError("give box_overlap, mask_overlap or a matching.Shape; overlaps() and hits() take any expression")
    return known[overlap]


def taken(truth: DataFrame, found: DataFrame, keys: list[str], overlap: Overlap | Shape, least: float) -> DataFrame:
    """hits() of overlaps(), from one shuffle of the shapes: their pairs are made, compared and taken inside tasks."""
    shape = _shape(overlap)
    rows = together(truth, found, keys, shape, F.asc_nulls_first(-F.col("score")), [])
    of = lambda c: rows.schema[c].dataType
    schema = StructType([rows.schema[k] for k in keys]).add("det", of("idx")).add("gt", of("idx")).add("score", of("score")).add("iou", DoubleType())

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, keys, shape):
            f, t, iou = block.hits(least)
            det, gt = block.table.take(f), block.table.column("idx").take(t)
            yield from pa.table([*[det.column(k) for k in keys], det.column("idx"), gt, det.column("score"), pa.array(iou)], names=schema.names).to_batches()

    return rows.mapInArrow(matched, schema)


def match_shapes(truth: DataFrame, found: DataFrame, keys: list[str], overlap: Overlap | Shape, threshold: float = 0.5) -> DataFrame:
    """keys, gt, predicted, tp, fp, fn and mean_iou for all keys of either side."""
    shape = _shape(overlap)
    rows = together(truth, found, keys, shape, F.asc_nulls_first(-F.col("score")), [])
    schema = StructType([rows.schema[k] for k in keys])
    for c in ("gt", "predicted", "tp"):
        schema = schema.add(c, LongType())

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, keys, shape):
            f, _, iou = block.hits(threshold)
            tp = np.bincount(block.group[f], minlength=len(block.starts))
            total = np.bincount(block.group[f], iou, len(block.starts))
            each = block.table.select(keys).take(block.starts)
            yield from pa.table([*each.columns, *[pa.array(c.astype(np.int64)) for c in (block.truths, block.predicted, tp)], pa.array(total.astype(np.float64))], names=[*schema.names, "_iou"]).to_batches()

    tp = F.col("tp")
    out = rows.mapInArrow(matched, StructType(schema.fields).add("_iou", DoubleType()))
    return out.select(*keys, "gt", "predicted", "tp", (F.col("predicted") - tp).alias("fp"), (F.col("gt") - tp).alias("fn"), ratio(F.col("_iou"), tp).alias("mean_iou"))


def question_summary(matches: DataFrame, question: str) -> DataFrame:
    """One row over match_shapes(): sums, micro scores, and macro scores and mean IoU over the questions. A question's
    counts are those of all its categories; scores without a denominator are 0."""
    each = matches.groupBy(question).agg(*[F.sum(c).alias(c) for c in ("gt", "predicted", "tp", "fp", "fn")], F.sum(F.col("mean_iou") * F.col("tp")).alias("_iou"))
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("gt"))
    exact = ratio(F.col("tp"), F.col("predicted"), None), ratio(F.col("tp"), F.col("gt"), None)
    each = each.withColumns({"_p": precision, "_r": recall, "_f": f1(*exact)})
    total = each.agg(
        F.count(F.lit(1)).alias("questions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gt", "predicted", "tp", "fp", "fn", "_iou")],
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"macro_{n}") for c, n in (("_p", "precision"), ("_r", "recall"), ("_f", "f1"))],
    )
    p, r = ratio(F.col("tp"), F.col("predicted"), None), ratio(F.col("tp"), F.col("gt"), None)
    return total.select("questions", "gt", "predicted", "tp", "fp", "fn", F.round(p, 6).alias("micro_precision"), F.round(r, 6).alias("micro_recall"), f1(p, r).alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1", ratio(F.col("_iou"), F.col("tp")).alias("mean_iou"))


def score_sweep(truth: DataFrame, found: DataFrame, taken: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """by, threshold, gt, predicted, tp, fp, fn, precision, recall, f1, mean_iou as if only detections with at least the
    threshold's score were matched, for all thresholds from one matching.

    taken: hits() of all detections. Detections and hits are counted between neighbouring thresholds and summed up from
    the highest one; nothing is matched again, and what is shuffled grows with groups and thresholds, not with rows."""
    cuts = sorted(set(thresholds))
    levels = F.array(*[F.lit(float(c)) for c in cuts])
    level = F.size(F.filter(levels, lambda c: c <= F.col("score"))) - 1
    zero = F.lit(0).cast("bigint")
    rows = found.select(*by, level.alias("_l"), F.lit(1).alias("_n"), zero.alias("_tp"), F.lit(0.0).alias("_iou"))
    rows = rows.unionByName(taken.select(*by, level.alias("_l"), zero.cast("int").alias("_n"), F.lit(1).cast("bigint").alias("_tp"), F.col("iou").alias("_iou")))
    counts = rows.where("_l >= 0").groupBy(*by, "_l").agg(*[F.sum(c).alias(c) for c in ("_n", "_tp", "_iou")])
    groups = truth.select(*by, F.lit(1).alias("_g")).unionByName(found.select(*by, F.lit(0).alias("_g"))).groupBy(*by).agg(F.sum("_g").alias("gt"))
    grid = groups.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))))
    same = F.col("g._l") == F.col("c._l")
    for c in by:
        same &= F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}"))
    full = grid.alias("g").join(counts.alias("c"), same, "left").select("g.*", *[F.coalesce(f"c.{c}", F.lit(0)).alias(c) for c in ("_n", "_tp", "_iou")])
    down = W.partitionBy(*by).orderBy(F.desc("_l")).rowsBetween(W.unboundedPreceding, 0)
    summed = full.withColumns({"predicted": F.sum("_n").over(down), "tp": F.sum("_tp").over(down), "_sum": F.sum("_iou").over(down)})
    p, r = ratio(F.col("tp"), F.col("predicted"), None), ratio(F.col("tp"), F.col("gt"), None)
    return summed.select(*by, F.element_at(levels, F.col("_l") + 1).alias("threshold"), "gt", "predicted", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("gt") - F.col("tp")).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), f1(p, r).alias("f1"), ratio(F.col("_sum"), F.col("tp")).alias("mean_iou"))


#: The protocol's areas and thresholds, each with each: place k is bit k of what _protocol_bits() marks.
_COMBOS = [(name, lo, hi, t) for name, (lo, hi) in AREAS.items() for t in THRESHOLDS]
#: The 101 recalls at which precision is read.
_RECALLS = np.arange(101) * 0.01


def _protocol_bits(truth: DataFrame, found: DataFrame, image: str, category: str, overlap: Overlap | Shape) -> DataFrame:
    """image, category, rank, score of each detection that counts, with _counted and _hit: of each combination of areas
    and thresholds one bit, that says whether it counts there and whether it is a hit."""
    keys, shape = [image, category], _shape(overlap)
    rows = together(truth, found, keys, shape, F.desc("score"), ["area"])
    schema = StructType([rows.schema[k] for k in keys]).add("rank", "integer").add("score", DoubleType()).add("_counted", LongType()).add("_hit", LongType())
    lo, hi = (np.array([c[i] for c in _COMBOS]) for i in (1, 2))
    at = np.minimum([c[3] for c in _COMBOS], 1 - 1e-10)
    bits = np.int64(1) << np.arange(len(_COMBOS), dtype=np.int64)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, keys, shape):
            size = block.numbers("_area")
            dets = np.flatnonzero(block.found & (block.rank < LIMITS[-1]))
            f, t, iou = block.near(dets, THRESHOLDS[0])
            order = np.lexsort((t, iou, f, block.rank[f]))
            f, t, iou = f[order], t[order], iou[order]
            true, place = np.unique(t, return_inverse=True)
            crowd = block.crowd[true][:, None]
            out = crowd | ~((size[true][:, None] >= lo) & (size[true][:, None] <= hi))
            used = np.zeros(out.shape, bool)
            inside = (size[dets][:, None] >= lo) & (size[dets][:, None] <= hi)
            counted, hit = inside @ bits, np.zeros(len(dets), np.int64)  # those that take nothing
            row = np.zeros(block.table.num_rows, np.int64)
            row[dets] = np.arange(len(dets))
            for s in block.rounds(f):
                p, n = place[s], np.arange(s.stop - s.start, dtype=np.int64)
                free = (iou[s][:, None] >= at) & (crowd[p] | ~used[p])
                # the last that fits of those that count, or else of the others
                value = np.where(free, n[:, None] + np.where(out[p], 0, len(n)), -1)
                first = np.flatnonzero(np.diff(f[s], prepend=-1))
                best = np.maximum.reduceat(value, first, axis=0)
                some, counts = best >= 0, best >= len(n)
                one, combo = np.nonzero(some)
                used[p[best[one, combo] % len(n)], combo] = True
                r = row[f[s][first]]
                counted[r] = (counts | ~some & inside[r]) @ bits
                hit[r] = counts @ bits
            kept = counted != 0
            rows_ = block.table.take(dets[kept])
            columns = [*[rows_.column(k) for k in keys], pa.array((block.rank[dets[kept]] + 1).astype(np.int32)), rows_.column("score").cast(pa.float64()), pa.array(counted[kept]), pa.array(hit[kept])]
            yield from pa.table(columns, names=schema.names).to_batches()

    return rows.mapInArrow(marked, schema)


def _each_combo() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("area_name"), F.lit(t).alias("iou_at")) for k, (name, _, _, t) in enumerate(_COMBOS)]))


def _bit(column: str) -> Column:
    return F.call_function("shiftright", F.col(column), F.col("_c.k")).bitwiseAND(F.lit(1)).cast("int")


def protocol_marks(truth: DataFrame, found: DataFrame, image: str, category: str, overlap: Overlap | Shape) -> DataFrame:
    """category, image, rank, score, area_name, iou_at and hit for each detection that counts, four areas and ten IoU
    thresholds: those that are neither a hit nor to be ignored are misses (hit 0).

    truth: image, category, idx, shape, area, crowd; found: image, category, idx, shape, area, score. The 100 detections
    of the highest score of an image and category count. Each, by falling score, takes the free truth that it overlaps
    most, the last of several. Truths out of the area, and crowds, are taken only where no other can be; what takes them
    is ignored, and crowds stay free. Detections out of the area that take nothing are ignored as well."""
    each = _protocol_bits(truth, found, image, category, overlap).withColumn("_c", _each_combo()).where(_bit("_counted") == 1)
    return each.select(category, image, "rank", "score", "_c.area_name", "_c.iou_at", _bit("_hit").alias("hit"))


def protocol_counts(truth: DataFrame, found: DataFrame, image: str, category: str, overlap: Overlap | Shape) -> DataFrame:
    """category, area_name, iou_at, counted and hits: the rows of protocol_marks() and, of these, the hits. A task counts
    its own marks before any are shuffled."""
    marks = protocol_marks(truth, found, image, category, overlap)
    return marks.groupBy(category, "area_name", "iou_at").agg(F.count(F.lit(1)).alias("counted"), F.sum("hit").alias("hits"))


def _precisions(bits: DataFrame, wanted: DataFrame, ranges: int = 64) -> DataFrame:
    """category, k (of _COMBOS), j and p: the highest precision at the hits of which the recall reaches the j-th of 101
    recalls and not the next. bits: category, image, rank, score, _counted, _hit; wanted: category, k, gt.

    Each category is cut into ranges at quantiles of the score. A range is read in order by one task, which goes on from
    the sums of the ranges before it: these come first, in a row of their own."""
    cuts = bits.groupBy(F.col("category").alias("_of")).agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 1000).alias("_cuts"))
    r = F.when(F.col("score").isNull(), ranges).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c > F.col("score"))))
    dealt = bits.join(cuts, F.col("category").eqNullSafe(F.col("_of"))).withColumn("_r", r).drop("_cuts", "_of")
    sums = dealt.groupBy("category", "_r", "_counted", "_hit").agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", _each_combo())
    sums = sums.groupBy("category", "_r", F.col("_c.k").alias("k")).agg(F.sum(F.col("_n") * _bit("_counted")).alias("_rows"), F.sum(F.col("_n") * _bit("_hit")).alias("_hits"))
    before = W.partitionBy("category", "k").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("category", "_r", "k", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("double").alias(c) for c in ("_rows", "_hits")])
    starts = starts.join(wanted, ["category", "k"])  # categories without truths have no curve
    starts = starts.groupBy("category", "_r").agg(F.array_sort(F.collect_list(F.struct("k", "_rows", "_hits", "gt"))).alias("_s"))
    starts = starts.select("category", "_r", *[F.col(f"_s.{c}").cast("array<double>").alias(n) for c, n in (("k", "_k"), ("_rows", "_rows"), ("_hits", "_hits"), ("gt", "_gt"))])
    stream = starts.withColumn("_data", F.lit(False)).unionByName(dealt.join(wanted.select("category").distinct(), "category").withColumn("_data", F.lit(True)), allowMissingColumns=True)
    stream = stream.repartition("category", "_r").sortWithinPartitions("category", "_r", "_data", F.desc("score"), "image", "rank")
    schema = StructType([stream.schema["category"]]).add("k", "integer").add("j", "integer").add("p", DoubleType())

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = name = None

        def ended() -> pa.RecordBatch:
            at, j = np.nonzero(best)
            return pa.RecordBatch.from_arrays([pa.repeat(name, len(at)), pa.array(combo[at].astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(best[at, j])], names=schema.names)

        for batch in batches:
            data = batch.column("_data").to_numpy(zero_copy_only=False)
            counted, hit = (np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in ("_counted", "_hit"))
            cuts_ = [*np.flatnonzero(~data), batch.num_rows]
            for a, b in zip([0, *cuts_[:-1]], cuts_, strict=True):
                if a < b and not data[a]:
                    if best is not None:
                        yield ended()
                    combo, rows, hits, gt = (np.array(batch.column(c)[a].as_py()) for c in ("_k", "_rows", "_hits", "_gt"))
                    combo, name, best, a = combo.astype(np.int64), batch.column("category")[a], np.zeros((len(combo), len(_RECALLS))), a + 1
                if a < b:
                    is_hit = (hit[a:b, None] >> combo) & 1
                    n, tp = rows + np.cumsum((counted[a:b, None] >> combo) & 1, axis=0), hits + np.cumsum(is_hit, axis=0)
                    rows, hits = n[-1], tp[-1]
                    r_, c_ = np.nonzero(is_hit)
                    tp = tp[r_, c_]
                    np.maximum.at(best, (c_, np.searchsorted(_RECALLS, tp / gt[c_], "right") - 1), tp / n[r_, c_])
        if best is not None:
            yield ended()

    return stream.mapInArrow(curves, schema).groupBy("category", "k", "j").agg(F.max("p").alias("p"))


def protocol_summary(truth: DataFrame, found: DataFrame, image: str, category: str, overlap: Overlap | Shape) -> DataFrame:
    """name and value of the protocol's twelve figures: ap, ap50, ap75, ap_small, ap_medium, ap_large, ar_max_1, ar_max_10,
    ar_max_100, ar_small, ar_medium, ar_large.

    Average precision is the mean of the highest precision at or behind 101 recalls; average recall is that of the first
    1, 10 or 100 detections. Means are over thresholds and the categories with truths of the area; null if there are none."""
    bits = _protocol_bits(truth, found, image, category, overlap)
    bits = Steps(truth.sparkSession).stored(bits.select(F.col(category).alias("category"), F.col(image).alias("image"), "rank", "score", "_counted", "_hit"))
    named = F.array(*[F.struct(F.lit(a).alias("area_name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, (lo, hi) in AREAS.items()])
    inside = truth.where(~F.coalesce("crowd", F.lit(False))).select(F.col(category).alias("category"), "area", F.explode(named).alias("a")).where("area >= a.lo and area <= a.hi")
    wanted = inside.groupBy("category", F.col("a.area_name").alias("area_name")).agg(F.count(F.lit(1)).alias("gt"))
    cells = wanted.withColumn("_c", _each_combo()).where("area_name = _c.area_name").select("category", "area_name", "_c.iou_at", "_c.k", "gt")
    # an envelope holds from the recall behind the one reached before it
    down = W.partitionBy("category", "k").orderBy(F.desc("j"))
    steps = _precisions(bits, cells.select("category", "k", "gt")).select("category", "k", (F.max("p").over(down) * (F.col("j") - F.lead("j", 1, -1).over(down))).alias("_part"))
    precise = steps.groupBy("category", "k").agg((F.sum("_part") / 101).alias("ap"))
    alike = bits.where("_hit <> 0").groupBy("category", "_hit").agg(*[F.count_if(F.col("rank") <= n).alias(f"_tp{n}") for n in LIMITS]).withColumn("_c", _each_combo()).where(_bit("_hit") == 1)
    recalled = alike.groupBy("category", "_c.k").agg(*[F.sum(f"_tp{n}").alias(f"_tp{n}") for n in LIMITS])
    full = cells.join(precise, ["category", "k"], "left").join(recalled, ["category", "k"], "left")
    ap = F.coalesce("ap", F.lit(0.0))
    ar = {n: F.coalesce(f"_tp{n}", F.lit(0)) / F.col("gt") for n in LIMITS}
    area_is, at = (lambda a: F.col("area_name") == a), (lambda t: F.col("iou_at") == t)
    figures = {"ap": (ap, area_is("all")), "ap50": (ap, area_is("all") & at(0.5)), "ap75": (ap, area_is("all") & at(0.75))}
    figures |= {f"ap_{a}": (ap, area_is(a)) for a in list(AREAS)[1:]} | {f"ar_max_{n}": (ar[n], area_is("all")) for n in LIMITS} | {f"ar_{a}": (ar[LIMITS[-1]], area_is(a)) for a in list(AREAS)[1:]}
    one = full.agg(*[F.round(F.avg(F.when(where, value)), 6).alias(name) for name, (value, where) in figures.items()])
    return one.unpivot([], list(figures), "name", "value")
