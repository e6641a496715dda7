"""Detections: greedy matching, suppression, average precision, relations between boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.functions.boxes import direction, iou
from visgauge.functions.stats import f1, ratio


def match_boxes(truth: DataFrame, found: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """keys, gt, predicted, tp, fp, fn and the mean IoU of the matches, for each image and category of either side.

    truth: keys, idx, box; found: keys, idx, box, score; boxes by corners. Detections are taken by falling score, then
    by idx; each takes the free box with the greatest IoU, the first of several, if that is at least threshold. The
    boxes of one image and category, few by nature, are folded over in one expression.
    """
    t = truth.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "box"))).alias("_t"))
    p = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "idx", "box"))).alias("_p"))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("used"), F.array().cast("array<double>").alias("ious"))

    def take(acc: Column, det: Column) -> Column:
        def scored(gt: Column, k: Column) -> Column:
            return F.struct(F.when(F.array_contains(acc["used"], k), F.lit(-1.0)).otherwise(iou(det["box"], gt["box"])).alias("iou"), (-k).alias("k"))

        best = F.array_max(F.transform(F.col("_t"), scored))
        good = F.coalesce((best["iou"] >= threshold) & (best["iou"] > 0), F.lit(False))
        return F.when(good, F.struct(F.array_append(acc["used"], -best["k"]).alias("used"), F.array_append(acc["ious"], best["iou"]).alias("ious"))).otherwise(acc)

    both = t.join(p, keys, "full").withColumns({"_t": F.coalesce("_t", F.expr("cast(array() as array<struct<idx:bigint,box:array<double>>>)")), "_n": F.greatest(F.size("_p"), F.lit(0))})
    matched = both.withColumn("_m", F.when(F.col("_p").isNotNull(), F.aggregate("_p", start, take)["ious"]))
    tp = F.greatest(F.size("_m"), F.lit(0))
    total = F.aggregate(F.coalesce("_m", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    return matched.select(*keys, F.size("_t").alias("gt"), F.col("_n").alias("predicted"), tp.alias("tp"), (F.col("_n") - tp).alias("fp"), (F.size("_t") - tp).alias("fn"), ratio(total, tp).alias("mean_iou"))


def match_summary(matches: DataFrame, by: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of match_boxes by some of its keys."""
    sums = matches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("gt", "predicted", "tp", "fp", "fn")])
    precision, recall = ratio(F.col("tp"), F.col("predicted"), None), ratio(F.col("tp"), F.col("gt"), None)
    return sums.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": f1(precision, recall)})


def suppress(found: DataFrame, image: str, threshold: float = 0.6) -> DataFrame:
    """image, idx of the detections (image, idx, label, box, score) that stay: by falling score, then by idx, a box goes
    if one that stays has the same label in any case and an IoU above threshold with it."""
    boxes = found.groupBy(image).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "idx", F.lower("label").alias("label"), "box"))).alias("_p"))
    start = F.expr("cast(array() as array<struct<o:double,idx:bigint,label:string,box:array<double>>>)")

    def keep(acc: Column, det: Column) -> Column:
        beaten = F.exists(acc, lambda k: (k["label"] == det["label"]) & (iou(k["box"], det["box"]) > threshold))
        return F.when(beaten, acc).otherwise(F.array_append(acc, det))

    typed = F.transform("_p", lambda x: F.struct(x["o"].cast("double").alias("o"), x["idx"].cast("bigint").alias("idx"), x["label"].alias("label"), x["box"].alias("box")))
    return boxes.select(image, F.explode(F.aggregate(typed, start, keep)).alias("_k")).select(image, F.col("_k.idx").alias("idx"))


def envelopes(found: DataFrame, group: str, score: Column, ties: list[Column], matched: Column, ranges: int = 64) -> DataFrame:
    """_g (the group), _tp (its number among the group's hits) and _env of each hit: the highest precision at its place or
    behind it, found being taken by falling score (nulls last), then by ties.

    Each group is cut into ranges at quantiles of the score, so that a large group is sorted by many tasks: ranks and
    hits inside a range go on from the sums of the ranges before it, and the envelope is the greater of the range's own
    running maximum from its end and that of the ranges behind it.
    """
    rows = found.select(F.col(group).alias("_g"), score.cast("double").alias("_s"), F.coalesce(matched.cast("int"), F.lit(0)).alias("_m"), *[c.alias(f"_t{i}") for i, c in enumerate(ties)])
    cuts = rows.groupBy(F.col("_g").alias("_of")).agg(F.percentile_approx("_s", [k / ranges for k in range(1, ranges)], 1000).alias("_cuts"))
    dealt = rows.join(cuts, F.col("_g").eqNullSafe(F.col("_of"))).withColumn("_r", F.when(F.col("_s").isNull(), ranges).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c > F.col("_s"))))).drop("_cuts", "_of")
    each = dealt.groupBy("_g", "_r").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_m").alias("_hits"))
    before = W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    starts = each.select(F.col("_g").alias("_of"), F.col("_r").alias("_at"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_hits")])
    inside = W.partitionBy("_g", "_r")
    down = inside.orderBy(F.desc_nulls_last("_s"), *[f"_t{i}" for i in range(len(ties))]).rowsBetween(W.unboundedPreceding, 0)
    ranked = dealt.withColumns({"_n": F.count(F.lit(1)).over(down), "_tp": F.sum("_m").over(down)})
    ranked = ranked.join(starts, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("_r") == F.col("_at")))
    precision = (F.col("_tp") + F.col("_hits_before")) / (F.col("_n") + F.col("_rows_before"))
    hits = ranked.where("_m = 1").select("_g", "_r", "_n", (F.col("_tp") + F.col("_hits_before")).alias("_tp"), precision.alias("_p"))  # precision rises at hits only
    own = hits.select("_g", "_r", "_tp", F.max("_p").over(inside.orderBy(F.desc("_n")).rowsBetween(W.unboundedPreceding, 0)).alias("_env"))
    behind = W.partitionBy("_g").orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)
    later = hits.groupBy("_g", "_r").agg(F.max("_p").alias("_top")).select(F.col("_g").alias("_of"), F.col("_r").alias("_at"), F.max("_top").over(behind).alias("_later"))
    return own.join(later, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("_r") == F.col("_at"))).select("_g", "_tp", F.greatest("_env", F.coalesce("_later", F.lit(0.0))).alias("_env"))


def average_precision(found: DataFrame, group: str, score: Column, ties: list[Column], matched: Column, truths: DataFrame, ranges: int = 64) -> DataFrame:
    """group and ap: the area under the envelope of precision over recall, all points.

    found is taken by falling score (nulls last), then by ties. truths: group and gt, the boxes there are to find. ap is
    null where gt is 0, and 0 where nothing was found. Large groups are sorted in ranges, by envelopes().
    """
    env = envelopes(found, group, score, ties, matched, ranges)
    steps = env.groupBy("_g").agg(F.sum("_env").alias("_sum"))
    ap = F.when(F.col("gt") > 0, F.round(F.coalesce(F.col("_sum"), F.lit(0.0)) / F.col("gt"), 6))
    return truths.select(group, "gt").join(steps, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, ap.alias("ap"))


def largest_relation(objects: DataFrame, image: str, most: int = 8, separation: float = 0.12, gap: float = 0.04) -> DataFrame:
    """image, subject, object, predicate, separation, axis_gap: the clearest relation between an image's largest objects.

    objects: image, idx, category, box by corners from 0 to 1, area. The largest object of each category counts, and the
    `most` largest of these; of the pairs that are far enough apart, the one with most separation and gap is taken.
    """
    first = W.partitionBy(image, "category").orderBy(F.desc("area"), "idx")
    size = W.partitionBy(image).orderBy(F.desc("area"), "idx")
    ranked = objects.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("_r", F.row_number().over(size)).where(F.col("_r") <= most)
    s, o = ranked.alias("s"), ranked.alias("o")
    dx, dy = ((F.col("s.box")[i] + F.col("s.box")[i + 2] - F.col("o.box")[i] - F.col("o.box")[i + 2]) / 2 for i in (0, 1))
    apart, clear = F.greatest(F.abs(dx), F.abs(dy)), F.abs(F.abs(dx) - F.abs(dy))
    pairs = s.join(o, (F.col(f"s.{image}") == F.col(f"o.{image}")) & (F.col("s._r") < F.col("o._r"))).where((apart >= separation) & (clear >= gap))
    one = F.struct(
        F.col("s.category").alias("subject"), F.col("o.category").alias("object"), direction(-dx, -dy, False).alias("predicate"), F.round(apart, 6).alias("separation"), F.round(clear, 6).alias("axis_gap")
    )
    best = F.max_by(one, F.struct(F.round(apart + clear, 9).alias("k0"), (-F.col("s._r")).alias("k1"), (-F.col("o._r")).alias("k2")))
    return pairs.groupBy(F.col(f"s.{image}").alias(image)).agg(best.alias("_b")).select(image, "_b.*")
