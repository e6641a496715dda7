"""Queries on boxes: every line of an order is a box of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.functions import boxes as b
from visgauge.operators import detection, policy
from visgauge.operators.ranking import top_k
from visgauge.operators.spread import partitions
from visgauge.plans.registry import Tables, query

_BOXES = """
    WITH l AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_returnflag AS category, l_linestatus AS side,
               l_extendedprice / 110000 AS score, l_quantity AS x, l_discount * 500 AS y, 10 + l_tax * 200 AS w, 20.0::DOUBLE AS h, l_suppkey FROM lineitem),
    b AS (SELECT *, [x, y, x + w, y + h] AS box FROM l)"""


def lines(t: Tables, parts: int | None = None) -> DataFrame:
    """The boxes; with parts, an image's rows are in one of so many partitions."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    xywh = F.array(F.col("l_quantity"), F.col("l_discount") * 500, 10 + F.col("l_tax") * 200, F.lit(20.0))
    table = t.lineitem if parts is None else t.lineitem.repartition(parts, "l_orderkey")
    rows = table.select(
        F.col("l_orderkey").alias("image"), F.row_number().over(order).cast("long").alias("idx"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("side"),
        (F.col("l_extendedprice") / 110000).alias("score"), b.corners(xywh).alias("box"),
    )
    return rows


@query(f"""{_BOXES} SELECT image, idx, round(w * h, 6) AS area, CASE WHEN w * h < 1024 THEN 'small' WHEN w * h < 9216 THEN 'medium' ELSE 'large' END AS size FROM (SELECT image, idx, (x + w) - x AS w, (y + h) - y AS h FROM b)""")
def box_areas(t: Tables) -> DataFrame:
    return lines(t).select("image", "idx", F.round(b.area(F.col("box")), 6).alias("area"), b.size_name(b.area(F.col("box"))).alias("size"))


@query(f"""{_BOXES}, p AS (SELECT a.image, a.idx AS one, c.idx AS two, a.box AS p, c.box AS q FROM b a JOIN b c ON a.image = c.image AND a.idx < c.idx),
    i AS (SELECT image, one, two, greatest(least(p[3], q[3]) - greatest(p[1], q[1]), 0) * greatest(least(p[4], q[4]) - greatest(p[2], q[2]), 0) AS common, (p[3] - p[1]) * (p[4] - p[2]) + (q[3] - q[1]) * (q[4] - q[2]) AS areas FROM p)
    SELECT image, one, two, round(common / (areas - common), 6) AS iou FROM i WHERE common > 0""")
def box_iou_pairs(t: Tables) -> DataFrame:
    rows = lines(t, partitions(t.lineitem))
    side = lambda n, at: rows.select("image", F.col("idx").alias(at), *[F.col("box")[i].alias(f"{n}{i}") for i in range(4)], b.area(F.col("box")).alias(f"{n}_area"))
    # plain numbers, of which most pairs need comparisons only: boxes that overlap have a common area
    pairs = side("p", "one").join(side("q", "two"), "image").where("one < two and p0 < q2 and q0 < p2 and p1 < q3 and q1 < p3")
    pairs = pairs.withColumn("common", F.expr("(least(p2, q2) - greatest(p0, q0)) * (least(p3, q3) - greatest(p1, q1))")).withColumn("iou", F.col("common") / (F.col("p_area") + F.col("q_area") - F.col("common"))).where("iou > 0")
    return pairs.select("image", "one", "two", F.round("iou", 6).alias("iou"))


_IOU = """greatest(least({p}[3], {q}[3]) - greatest({p}[1], {q}[1]), 0) * greatest(least({p}[4], {q}[4]) - greatest({p}[2], {q}[2]), 0)
    / (({p}[3] - {p}[1]) * ({p}[4] - {p}[2]) + ({q}[3] - {q}[1]) * ({q}[4] - {q}[2]) - greatest(least({p}[3], {q}[3]) - greatest({p}[1], {q}[1]), 0) * greatest(least({p}[4], {q}[4]) - greatest({p}[2], {q}[2]), 0))"""
#: One detection a round: the free truth of the greatest IoU, the first of several, is taken if that reaches 0.3.
_GREEDY = f"""{_BOXES.replace("WITH l", "WITH RECURSIVE l")},
    t AS (SELECT image, category, list({{'idx': idx, 'box': box}} ORDER BY idx) AS ts FROM b WHERE side = 'F' GROUP BY 1, 2),
    p AS (SELECT image, category, list({{'score': score, 'idx': idx, 'box': box}} ORDER BY score DESC, idx) AS ps FROM b WHERE side = 'O' GROUP BY 1, 2),
    g AS (SELECT image, category, coalesce(ts, []) AS ts, coalesce(ps, []) AS ps FROM t FULL JOIN p USING (image, category)),
    r AS (SELECT image, category, ts, ps, 1 AS n, []::BIGINT[] AS used, []::DOUBLE[] AS ious FROM g
          UNION ALL
          SELECT image, category, ts, ps, n + 1, CASE WHEN top.iou >= 0.3 THEN list_append(used, top.k) ELSE used END, CASE WHEN top.iou >= 0.3 THEN list_append(ious, top.iou) ELSE ious END
          FROM (SELECT *, list_aggregate(list_append(list_transform(list_filter(range(1, len(ts) + 1), lambda k: NOT list_contains(used, k)),
                       lambda k: {{'iou': {_IOU.format(p="ps[n].box", q="ts[k].box")}, 'back': -k, 'k': k}}), {{'iou': -1.0::DOUBLE, 'back': 0::BIGINT, 'k': 0::BIGINT}}), 'max') AS top FROM r WHERE n <= len(ps))),
    m AS (SELECT image, category, len(ts) AS gt, len(ps) AS predicted, len(ious) AS tp, coalesce(list_sum(ious), 0) AS total FROM r WHERE n = len(ps) + 1)"""


def _matches(t: Tables) -> DataFrame:
    rows = lines(t)
    truth = rows.where("side = 'F'").select("image", "category", "idx", "box")
    found = rows.where("side = 'O'").select("image", "category", "idx", "box", "score")
    return detection.match_boxes(truth, found, ["image", "category"], 0.3)


@query(f"{_GREEDY} SELECT image, category, gt::INTEGER AS gt, predicted::INTEGER AS predicted, tp::INTEGER AS tp, (predicted - tp)::INTEGER AS fp, (gt - tp)::INTEGER AS fn, round(coalesce(total / nullif(tp, 0), 0), 6) AS mean_iou FROM m")
def greedy_match(t: Tables) -> DataFrame:
    return _matches(t)


@query(f"""{_GREEDY}, s AS (SELECT category, sum(gt)::BIGINT AS gt, sum(predicted)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM m GROUP BY 1)
    SELECT category, gt, predicted, tp, predicted - tp AS fp, gt - tp AS fn, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(gt, 0), 0), 6) AS recall,
           round(coalesce(2 * tp / nullif(predicted + gt, 0), 0), 6) AS f1 FROM s""")
def match_summary(t: Tables) -> DataFrame:
    return detection.match_summary(_matches(t), ["category"])


@query(f"""{_BOXES.replace("WITH l", "WITH RECURSIVE l")},
    g AS (SELECT image, list({{'score': score, 'idx': idx, 'label': lower(category), 'box': box}} ORDER BY score DESC, idx) AS ps FROM b GROUP BY 1),
    r AS (SELECT image, ps, 1 AS n, []::BIGINT[] AS kept FROM g
          UNION ALL
          SELECT image, ps, n + 1, CASE WHEN len(list_filter(kept, lambda k: ps[k].label = ps[n].label AND {_IOU.format(p="ps[k].box", q="ps[n].box")} > 0.4)) = 0 THEN list_append(kept, n) ELSE kept END FROM r WHERE n <= len(ps))
    SELECT image, ps[k].idx AS idx FROM (SELECT image, ps, unnest(kept) AS k FROM r WHERE n = len(ps) + 1)""")
def suppressed_boxes(t: Tables) -> DataFrame:
    return detection.suppress(lines(t).withColumnRenamed("category", "label"), "image", 0.4)


@query("""
    WITH e AS (SELECT event_type, value, event_id, (event_id % 3 = 0)::INT AS m FROM events),
    c AS (SELECT *, sum(m) OVER w AS tp, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id)),
    v AS (SELECT *, max(tp / n) OVER (PARTITION BY event_type ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c),
    g AS (SELECT event_type, count(*) AS gt FROM events WHERE event_id % 3 = 0 GROUP BY 1)
    SELECT event_type, round(coalesce(sum(env) FILTER (m = 1), 0) / any_value(gt), 6) AS ap FROM v JOIN g USING (event_type) GROUP BY 1""")
def average_precision(t: Tables) -> DataFrame:
    hit = F.col("event_id") % 3 == 0
    truths = t.events.groupBy("event_type").agg(F.count_if(hit).alias("gt"))
    return detection.average_precision(t.events, "event_type", F.col("value"), [F.col("event_id")], hit, truths)


@query(f"""{_BOXES}, o AS (SELECT image, idx, category || side AS category, [x / 100, y / 100, x / 100 + w / 100, y / 100 + h / 100] AS box, (w / 100) * (h / 100) AS a FROM b),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY image, category ORDER BY round(a, 9) DESC, idx) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(a, 9) DESC, idx) AS r FROM f),
    p AS (SELECT s.image, s.category AS subject, q.category AS object, (s.box[1] + s.box[3] - q.box[1] - q.box[3]) / 2 AS dx, (s.box[2] + s.box[4] - q.box[2] - q.box[4]) / 2 AS dy, s.r AS sr, q.r AS qr FROM r s JOIN r q ON s.image = q.image AND s.r < q.r),
    g AS (SELECT *, greatest(abs(dx), abs(dy)) AS sep, abs(abs(dx) - abs(dy)) AS gap FROM p),
    w AS (SELECT * FROM g WHERE sep >= 0.12 AND gap >= 0.04 QUALIFY row_number() OVER (PARTITION BY image ORDER BY round(sep + gap, 9) DESC, sr, qr) = 1)
    SELECT image, subject, object, CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN dx > 0 THEN 'to the right of' ELSE 'to the left of' END ELSE CASE WHEN dy > 0 THEN 'below' ELSE 'above' END END AS predicate,
           round(sep, 6) AS separation, round(gap, 6) AS axis_gap FROM w""")
def geometric_relation(t: Tables) -> DataFrame:
    xywh = [F.col("l_quantity") / 100, F.col("l_discount") * 500 / 100, (10 + F.col("l_tax") * 200) / 100, F.lit(20.0) / 100]
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("image"), F.row_number().over(order).alias("idx"), F.concat("l_returnflag", "l_linestatus").alias("category"),
        F.array(xywh[0], xywh[1], xywh[0] + xywh[2], xywh[1] + xywh[3]).alias("box"), F.round(xywh[2] * xywh[3], 9).alias("area"),
    )
    return detection.largest_relation(rows, "image")


_GATE = policy.Gate(score=0.3, promotion=0.8, least_area=210.0 / 10000, most_area=380.0 / 10000)
_JUDGED = f"""{_BOXES}, s AS (SELECT image, idx, category, score, round(w * h, 6) AS a FROM (SELECT image, idx, category, score, (x + w) - x AS w, (y + h) - y AS h FROM b)),
    r AS (SELECT image, idx, category, score, list_filter([CASE WHEN score < 0.3 THEN 'low_score' END, CASE WHEN a < 210 THEN 'small_area' END, CASE WHEN a > 380 THEN 'large_area' END], lambda v: v IS NOT NULL) AS reasons FROM s)"""


def _judged(t: Tables) -> DataFrame:
    rows = lines(t).withColumn("share", F.round(b.area(F.col("box")), 6) / 10000)
    unit = F.array(F.lit(0.0), F.lit(0.0), F.col("share"), F.lit(1.0))
    return rows.select("image", "idx", "category", "score", policy.rejections(F.col("score"), unit, _GATE).alias("reasons"))


@query(f"{_JUDGED} SELECT image, idx, array_to_string(reasons, ';') AS reasons FROM r")
def evidence_gate(t: Tables) -> DataFrame:
    return _judged(t).select("image", "idx", F.array_join("reasons", ";").alias("reasons"))


@query(f"""{_JUDGED}, e AS (SELECT image, count(*) AS accepted, max(score) AS strongest FROM r WHERE len(reasons) = 0 GROUP BY 1),
    a AS (SELECT o_orderkey AS image, CASE o_orderstatus WHEN 'F' THEN 'yes' ELSE 'no' END AS answer FROM orders),
    j AS (SELECT image, answer, coalesce(accepted, 0) AS accepted, round(coalesce(strongest, 0), 6) AS strongest FROM a LEFT JOIN e USING (image))
    SELECT *, CASE WHEN answer = 'no' AND accepted > 0 AND strongest >= 0.8 THEN 'yes' ELSE answer END AS final_answer,
           CASE WHEN answer = 'no' AND accepted > 0 AND strongest >= 0.8 THEN 'promoted_by_localized_evidence' WHEN answer = 'no' AND accepted > 0 THEN 'negative_preserved_below_promotion_threshold'
                WHEN answer = 'no' THEN 'negative_preserved_without_evidence' WHEN accepted > 0 THEN 'positive_supported_by_localized_evidence' ELSE 'positive_preserved_without_evidence' END AS status FROM j""")
def rescue_policy(t: Tables) -> DataFrame:
    answers = t.orders.select(F.col("o_orderkey").alias("image"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("answer"))
    return policy.rescue(answers, _judged(t).where("size(reasons) = 0").select("image", "score"), "image", "answer", _GATE)


@query(f"""{_JUDGED}, c AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY score DESC, idx) AS rank, CASE category WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No' ELSE 'Yes.' END AS review FROM r WHERE len(reasons) = 0),
    e AS (SELECT image, count(*) AS reviews, min(rank) FILTER (lower(trim(review)) = 'yes') AS confirmed, count(*) FILTER (lower(trim(review)) NOT IN ('yes', 'no')) AS unclear FROM c WHERE rank <= 3 GROUP BY 1),
    a AS (SELECT o_orderkey AS image, CASE o_orderstatus WHEN 'F' THEN 'yes' ELSE 'no' END AS answer FROM orders),
    j AS (SELECT image, answer, coalesce(reviews, 0) AS reviews, confirmed::INTEGER AS confirmed, coalesce(unclear, 0) AS unclear FROM a LEFT JOIN e USING (image))
    SELECT *, CASE WHEN answer = 'no' AND confirmed IS NOT NULL THEN 'yes' ELSE answer END AS final_answer, CASE WHEN answer = 'no' AND confirmed IS NOT NULL THEN 'promoted' WHEN answer = 'no' AND reviews = 0 THEN 'kept_without_candidates'
           WHEN answer = 'no' AND unclear > 0 THEN 'kept_unclear' WHEN answer = 'no' THEN 'kept_rejected' ELSE 'kept_positive' END AS status FROM j""")
def review_policy(t: Tables) -> DataFrame:
    answers = t.orders.select(F.col("o_orderkey").alias("image"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("answer"))
    seen = top_k(_judged(t).where("size(reasons) = 0"), ["image"], [F.desc("score"), F.col("idx")], 3)
    reviews = seen.select("image", "rank", F.when(F.col("category") == "A", "Yes").when(F.col("category") == "N", "No").otherwise("Yes.").alias("review"))
    return policy.rescue_by_review(answers, reviews, "image", "answer")
