"""Queries on shapes: the lines of 16 orders are the true and found shapes of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.functions import masks
from visgauge.operators import protocol, replay
from visgauge.operators.assignment import balanced_negatives
from visgauge.operators.spread import partitions
from visgauge.plans.registry import Tables, query

_SHAPES = """
    s AS (SELECT l_orderkey // 16 AS image, l_returnflag AS category, row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_partkey % 2 = 0 AS truth,
                 l_extendedprice / 110000 AS score, l_discount >= 0.09 AS crowd, (l_partkey % 3) * 10.0::DOUBLE AS x, (l_suppkey % 3) * 8.0::DOUBLE AS y, 30.0::DOUBLE + (l_quantity::BIGINT % 4) * 20 AS w, 30.0::DOUBLE + (l_linenumber % 4) * 25 AS h,
                 (l_partkey % 3) * 5 AS c1, 10 + (l_quantity::BIGINT % 4) * 5 AS c2, l_suppkey % 4 AS c3, 5 + l_linenumber * 2 AS c4 FROM lineitem),
    t AS (SELECT * FROM s WHERE truth), p AS (SELECT * FROM s WHERE NOT truth)"""
_IOU = """(SELECT p.image, p.category, p.idx AS det, p.score, t.idx AS gt, t.crowd AND {crowds} AS crowd, t.w * t.h AS area,
    greatest(least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x), 0) * greatest(least(p.y + p.h, t.y + t.h) - greatest(p.y, t.y), 0) AS common, p.w * p.h AS own FROM p JOIN t ON p.image = t.image AND p.category = t.category)"""
#: One candidate a round, in order: it is taken if neither its detection nor its truth is.
_TAKEN = """
    c AS (SELECT {keys}, list({{'det': det, 'gt': gt, 'iou': iou, 'score': score}} ORDER BY score DESC, det, iou DESC, gt) AS c FROM near GROUP BY ALL),
    r AS (SELECT {keys}, c, 1 AS n, []::BIGINT[] AS dets, []::BIGINT[] AS gts, []::DOUBLE[] AS ious FROM c
          UNION ALL
          SELECT {keys}, c, n + 1, CASE WHEN free THEN list_append(dets, c[n].det) ELSE dets END, CASE WHEN free THEN list_append(gts, c[n].gt) ELSE gts END, CASE WHEN free THEN list_append(ious, c[n].iou) ELSE ious END
          FROM (SELECT *, NOT list_contains(dets, c[n].det) AND NOT list_contains(gts, c[n].gt) AS free FROM r WHERE n <= len(c))),
    m AS (SELECT {keys}, len(gts) AS tp, list_sum(ious) AS total FROM r WHERE n = len(c) + 1)"""
_PIXELS = f"""WITH RECURSIVE {_SHAPES},
    px AS (SELECT *, unnest(range(c1, c1 + c2) || range(c1 + c2 + c3, c1 + c2 + c3 + c4)) AS px FROM s),
    i AS (SELECT a.image, a.category, a.idx AS det, b.idx AS gt, count(*) AS common FROM px a JOIN px b ON a.image = b.image AND a.category = b.category AND a.px = b.px WHERE NOT a.truth AND b.truth GROUP BY ALL),
    near AS (SELECT i.image, i.category, det, p.score, gt, common / CASE WHEN t.crowd THEN p.c2 + p.c4 ELSE p.c2 + p.c4 + t.c2 + t.c4 - common END AS iou
             FROM i JOIN p ON p.image = i.image AND p.idx = det JOIN t ON t.image = i.image AND t.idx = gt WHERE iou >= 0.5),
    {_TAKEN.format(keys="image, category")},
    g AS (SELECT image, category, count(*) FILTER (truth) AS gt, count(*) FILTER (NOT truth) AS predicted FROM s GROUP BY 1, 2),
    f AS (SELECT image, category, gt, predicted, coalesce(tp, 0) AS tp, coalesce(total, 0) AS total FROM g LEFT JOIN m USING (image, category))"""


def shapes(t: Tables) -> DataFrame:
    order = W.partitionBy("image").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x, y = (F.col("l_partkey") % 3) * F.lit(10.0), (F.col("l_suppkey") % 3) * F.lit(8.0)
    w, h = F.lit(30.0) + (F.col("l_quantity").cast("long") % 4) * 20, F.lit(30.0) + (F.col("l_linenumber") % 4) * 25
    counts = F.array((F.col("l_partkey") % 3) * 5, 10 + (F.col("l_quantity").cast("long") % 4) * 5, F.col("l_suppkey") % 4, 5 + F.col("l_linenumber") * 2)
    rows = t.lineitem.withColumn("image", F.floor(F.col("l_orderkey") / 16))
    return rows.select(
        "image", F.col("l_returnflag").alias("category"), F.row_number().over(order).cast("long").alias("idx"), (F.col("l_partkey") % 2 == 0).alias("truth"), (F.col("l_extendedprice") / 110000).alias("score"),
        (F.col("l_discount") >= 0.09).alias("crowd"), F.array(x, y, x + w, y + h).alias("box"), (w * h).alias("area"), counts.alias("counts"),
    )


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("truth"), rows.where("not truth")


def _mask_matches(t: Tables) -> DataFrame:
    truth, found = _sides(shapes(t).withColumn("shape", masks.edges(F.col("counts"))))
    return protocol.match_shapes(truth, found, ["image", "category"], masks.mask_overlap, 0.5)


@query(f"{_PIXELS} SELECT image, category, gt, predicted, tp::BIGINT AS tp, (predicted - tp)::BIGINT AS fp, (gt - tp)::BIGINT AS fn, round(coalesce(total / nullif(tp, 0), 0), 6) AS mean_iou FROM f")
def mask_match(t: Tables) -> DataFrame:
    return _mask_matches(t)


@query(f"""{_PIXELS}, q AS (SELECT image, sum(gt) AS gt, sum(predicted) AS predicted, sum(tp) AS tp, sum(total) AS total FROM f GROUP BY 1),
    e AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(gt, 0), 0) AS r FROM q),
    a AS (SELECT count(*) AS questions, sum(gt) AS gt, sum(predicted) AS predicted, sum(tp) AS tp, sum(total) AS total, avg(round(p, 6)) AS mp, avg(round(r, 6)) AS mr, avg(round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6)) AS mf FROM e)
    SELECT questions, gt::BIGINT AS gt, predicted::BIGINT AS predicted, tp::BIGINT AS tp, (predicted - tp)::BIGINT AS fp, (gt - tp)::BIGINT AS fn, round(tp / predicted, 6) AS micro_precision, round(tp / gt, 6) AS micro_recall,
           round(2 * tp / (predicted + gt), 6) AS micro_f1, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(total / tp, 6) AS mean_iou FROM a""")
def mask_summary(t: Tables) -> DataFrame:
    return protocol.question_summary(_mask_matches(t), "image")


_CUTS = (0.1, 0.25, 0.4, 0.5, 0.6, 0.7, 0.8)


@query(f"""WITH RECURSIVE {_SHAPES}, cuts AS (SELECT unnest({list(_CUTS)}::DOUBLE[]) AS threshold),
    near AS (SELECT threshold, image, category, det, gt, score, common / (own + area - common) AS iou FROM {_IOU.format(crowds="false")} JOIN cuts ON score >= threshold WHERE iou >= 0.5),
    {_TAKEN.format(keys="threshold, image, category")},
    tps AS (SELECT threshold, category, sum(tp)::BIGINT AS tp, sum(total) AS total FROM m GROUP BY ALL),
    n AS (SELECT threshold, category, count(*) FILTER (truth) AS gt, count(*) FILTER (NOT truth AND score >= threshold) AS predicted FROM s, cuts GROUP BY ALL),
    f AS (SELECT category, threshold, gt, predicted, coalesce(tp, 0) AS tp, coalesce(total, 0) AS total FROM n LEFT JOIN tps USING (threshold, category))
    SELECT category, threshold, gt, predicted, tp, predicted - tp AS fp, gt - tp AS fn, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(gt, 0), 0), 6) AS recall,
           round(coalesce(2 * tp / nullif(predicted + gt, 0), 0), 6) AS f1, round(coalesce(total / nullif(tp, 0), 0), 6) AS mean_iou FROM f""")
def score_sweep(t: Tables) -> DataFrame:
    truth, found = _sides(shapes(t).withColumn("shape", F.col("box")).withColumn("crowd", F.lit(False)))
    keys = ["image", "category"]
    taken = protocol.taken(truth, found, keys, protocol.box_overlap, 0.5)
    return protocol.score_sweep(truth, found, taken, ["category"], list(_CUTS))


_PROTOCOL = f"""WITH RECURSIVE {_SHAPES},
    areas AS (SELECT unnest(['all', 'small', 'medium', 'large']) AS name, unnest([0, 0, 1024, 9216]) AS lo, unnest([1e10, 1024, 9216, 1e10]) AS hi),
    cuts AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS cut),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY image, category ORDER BY score DESC, idx) AS rank FROM p QUALIFY rank <= 100),
    near AS (SELECT image, category, det, list({{'gt': gt, 'crowd': crowd, 'area': area, 'iou': iou}}) AS near
             FROM (SELECT *, common / CASE WHEN crowd THEN own ELSE own + area - common END AS iou FROM {_IOU.format(crowds="true")} WHERE iou >= 0.5) GROUP BY 1, 2, 3),
    d AS (SELECT k.image, k.category, list({{'rank': rank, 'score': score, 'area': w * h, 'near': coalesce(near, [])}} ORDER BY rank) AS ds FROM ranked k LEFT JOIN near n ON k.image = n.image AND k.idx = n.det GROUP BY 1, 2),
    r AS (SELECT image, category, name, lo, hi, cut, ds, 1 AS n, []::BIGINT[] AS used, []::INTEGER[] AS marks FROM d, areas, cuts
          UNION ALL
          SELECT image, category, name, lo, hi, cut, ds, n + 1, CASE WHEN best.gt >= 0 THEN list_append(used, best.gt) ELSE used END,
                 list_append(marks, CASE WHEN best.gt >= 0 THEN CASE WHEN best.counts = 1 THEN 1 ELSE 2 END WHEN ds[n].area BETWEEN lo AND hi THEN 0 ELSE 2 END)
          FROM (SELECT *, list_aggregate(list_append(list_transform(list_filter(ds[n].near, lambda c: c.iou >= cut AND (c.crowd OR NOT list_contains(used, c.gt))),
                       lambda c: {{'counts': CASE WHEN c.crowd OR c.area < lo OR c.area > hi THEN 0 ELSE 1 END, 'iou': c.iou, 'gt': c.gt}}), {{'counts': -1, 'iou': -1.0::DOUBLE, 'gt': -1::BIGINT}}), 'max') AS best FROM r WHERE n <= len(ds))),
    marks AS (SELECT image, category, name, cut, unnest(ds).rank AS rank, unnest(ds).score AS score, unnest(marks) AS hit FROM r WHERE n = len(ds) + 1),
    kept AS (SELECT * FROM marks WHERE hit < 2),
    cells AS (SELECT category, name, cut, count(*) AS gt FROM t, areas, cuts WHERE NOT crowd AND w * h BETWEEN lo AND hi GROUP BY ALL),
    run AS (SELECT *, sum(hit) OVER w AS tp, row_number() OVER w AS n FROM kept WINDOW w AS (PARTITION BY category, name, cut ORDER BY score DESC, image, rank)),
    env AS (SELECT *, max(tp / n) OVER (PARTITION BY category, name, cut ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM run),
    ap AS (SELECT category, name, cut, sum(env * (SELECT count(*) FROM range(101) x(i) WHERE i * 0.01::DOUBLE <= tp / gt AND (tp = 1 OR i * 0.01::DOUBLE > (tp - 1) / gt))) / 101 AS ap FROM env JOIN cells USING (category, name, cut) WHERE hit = 1 GROUP BY ALL),
    ar AS (SELECT category, name, cut, count(*) FILTER (rank <= 1) AS n1, count(*) FILTER (rank <= 10) AS n10, count(*) AS n100 FROM kept WHERE hit = 1 GROUP BY ALL),
    f AS (SELECT name, cut, coalesce(ap, 0) AS ap, coalesce(n1, 0) / gt AS ar1, coalesce(n10, 0) / gt AS ar10, coalesce(n100, 0) / gt AS ar100 FROM cells LEFT JOIN ap USING (category, name, cut) LEFT JOIN ar USING (category, name, cut))"""


@query(f"""{_PROTOCOL} SELECT unnest(['ap', 'ap50', 'ap75', 'ap_small', 'ap_medium', 'ap_large', 'ar_max_1', 'ar_max_10', 'ar_max_100', 'ar_small', 'ar_medium', 'ar_large']) AS name,
    unnest(list_transform([avg(ap) FILTER (name = 'all'), avg(ap) FILTER (name = 'all' AND cut = 0.5), avg(ap) FILTER (name = 'all' AND cut = 0.75), avg(ap) FILTER (name = 'small'), avg(ap) FILTER (name = 'medium'), avg(ap) FILTER (name = 'large'),
           avg(ar1) FILTER (name = 'all'), avg(ar10) FILTER (name = 'all'), avg(ar100) FILTER (name = 'all'), avg(ar100) FILTER (name = 'small'), avg(ar100) FILTER (name = 'medium'), avg(ar100) FILTER (name = 'large')], lambda v: round(v, 6))) AS value FROM f""")
def protocol_summary(t: Tables) -> DataFrame:
    truth, found = _sides(shapes(t).withColumn("shape", F.col("box")))
    return protocol.protocol_summary(truth, found, "image", "category", protocol.box_overlap)


@query(f"{_PROTOCOL} SELECT category, name AS area_name, cut AS iou_at, count(*) AS counted, sum(hit)::BIGINT AS hits FROM kept GROUP BY ALL")
def protocol_marks(t: Tables) -> DataFrame:
    truth, found = _sides(shapes(t).withColumn("shape", F.col("box")))
    return protocol.protocol_counts(truth, found, "image", "category", protocol.box_overlap)


_AXES: dict[str, list[float | None]] = {"score": [0.0, 0.2, 0.4, 0.55, 0.7], "mask_score": [None, 0.3, 0.6], "area": [0.0, 0.03, 0.06]}


@query(f"""
    WITH e AS (SELECT l_orderkey AS image, 'c' || (l_partkey % 5) AS category, l_extendedprice / 110000 AS score, CASE WHEN l_linenumber < 6 THEN l_discount * 10 END AS mask, l_tax AS area FROM lineitem),
    w AS (SELECT o_orderkey AS image, CASE WHEN o_custkey % 7 = 0 THEN [] ELSE list_distinct(['c' || (o_custkey % 5), 'c' || (o_custkey // 5 % 5)]) END AS wanted FROM orders),
    c AS (SELECT * FROM (SELECT unnest({_AXES["score"]}::DOUBLE[]) AS score), (SELECT unnest([NULL, 0.3, 0.6]::DOUBLE[]) AS mask_score), (SELECT unnest({_AXES["area"]}::DOUBLE[]) AS area)),
    a AS (SELECT c.score, c.mask_score, c.area, image, list(DISTINCT category) AS found FROM c JOIN e ON e.score >= c.score AND (c.mask_score IS NULL OR e.mask >= c.mask_score) AND e.area >= c.area GROUP BY ALL),
    f AS (SELECT c.score, c.mask_score, c.area, w.image, wanted, coalesce(found, []) AS found FROM c CROSS JOIN w LEFT JOIN a ON a.image = w.image AND a.score = c.score AND a.mask_score IS NOT DISTINCT FROM c.mask_score AND a.area = c.area),
    s AS (SELECT *, len(list_intersect(wanted, found)) AS h, len(found) AS n, len(wanted) AS m FROM f)
    SELECT score, mask_score, area, count(*) AS images, count(*) FILTER (n > 0) AS answered, round(count(*) FILTER (n > 0) / count(*), 6) AS coverage, round(avg(coalesce(h / nullif(n, 0), 0)), 6) AS "precision",
           round(avg(coalesce(h / nullif(m, 0), 0)), 6) AS recall, round(avg(coalesce(2 * h / nullif(n + m, 0), 0)), 6) AS f1, round(avg((h = n AND h = m)::INT), 6) AS exact,
           round(coalesce(sum(coalesce(2 * h / nullif(n + m, 0), 0)) / nullif(count(*) FILTER (n > 0), 0), 0), 6) AS selective_f1, round(coalesce(count(*) FILTER (n > 0 AND h = n AND h = m) / nullif(count(*) FILTER (n > 0), 0), 0), 6) AS selective_exact
    FROM s GROUP BY ALL""")
def listing_sweep(t: Tables) -> DataFrame:
    evidence = t.lineitem.select(
        F.col("l_orderkey").alias("image"), F.concat(F.lit("c"), F.col("l_partkey") % 5).alias("category"), (F.col("l_extendedprice") / 110000).alias("score"),
        F.when(F.col("l_linenumber") < 6, F.col("l_discount") * 10).alias("mask_score"), F.col("l_tax").alias("area"),
    )
    named = F.array(F.concat(F.lit("c"), F.col("o_custkey") % 5), F.concat(F.lit("c"), F.floor(F.col("o_custkey") / 5) % 5))
    targets = t.orders.select(F.col("o_orderkey").alias("image"), F.when(F.col("o_custkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(named)).alias("wanted"))
    return replay.sweep_listings(evidence, targets, "image", "category", "wanted", _AXES, partitions(t.lineitem))


@query("""
    WITH g AS (SELECT n, n % 4 AS g FROM range(80) r(n)),
    p AS (SELECT DISTINCT l_orderkey AS image, l_partkey % 80 AS positive FROM lineitem),
    w AS (SELECT positive % 4 AS g, count(*) AS wanted FROM p GROUP BY 1)
    SELECT 'g' || g AS "group", wanted AS requests, 20::BIGINT AS names, (wanted // 20)::BIGINT AS least, ((wanted + 19) // 20)::BIGINT AS most, 0::BIGINT AS present, 0::BIGINT AS repeated FROM w""")
def even_negatives(t: Tables) -> DataFrame:
    """Not the assignment, which hangs on hashes, but what it promises: all requests served, uses that differ by one at most,
    no name that is present or twice in an image."""
    name = lambda c: F.concat(F.lit("n"), c)
    group = lambda c: F.concat(F.lit("g"), c % 4)
    lines = t.lineitem.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 80).alias("n")).distinct()
    present = lines.groupBy("image").agg(F.collect_list(name(F.col("n"))).alias("present"))
    requests = lines.join(present, "image").select("image", name(F.col("n")).alias("positive"), group(F.col("n")).alias("group"), "present")
    found = balanced_negatives(requests, [(f"g{n % 4}", f"n{n}") for n in range(80)]).where("selection = 'same_group'")
    facts = found.join(present.withColumn("image", F.col("image").cast("string")), "image").withColumn("group", group(F.substring("name", 2, 9).cast("long")))
    once = W.partitionBy("image", "name")
    marked = facts.withColumns({"_again": (F.row_number().over(once.orderBy("positive")) > 1).cast("long"), "_there": F.array_contains("present", F.col("name")).cast("long")})
    uses = marked.groupBy("group", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("_there").alias("present"), F.sum("_again").alias("repeated"))
    return uses.groupBy("group").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("names"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("present").alias("present"), F.sum("repeated").alias("repeated"))
