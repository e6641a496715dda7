"""Masks as run lengths, and detections matched once: against pixels and plain matching."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from visgauge.functions import masks
from visgauge.operators import protocol, replay
from visgauge.operators.detection import match_boxes, match_summary

BOXES = "image long, category string, idx long, shape array<double>, area double, crowd boolean"
FOUND = "image long, category string, idx long, shape array<double>, area double, score double"


def pixels(edges: list[int]) -> set[int]:
    return {p for a, b in zip(edges[::2], edges[1::2], strict=False) for p in range(a, b)}


def compressed(counts: list[int]) -> str:
    out = ""
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        while True:
            bits, x = x & 31, x >> 5
            more = x != (-1 if bits & 16 else 0)
            out += chr(48 + bits + 32 * more)
            if not more:
                break
    return out


def test_masks_against_pixels(spark):
    rnd = random.Random(1)
    pairs = [([rnd.choice([0, 1, 3, 40, 700]) for _ in range(rnd.randrange(9))], [rnd.choice([0, 2, 5, 33]) for _ in range(rnd.randrange(9))]) for _ in range(150)]
    df = spark.createDataFrame([(a, b, compressed(a)) for a, b in pairs], "a array<long>, b array<long>, text string")
    a, b = masks.edges(F.col("a")), masks.edges(F.col("b"))
    rows = df.select(
        a.alias("ea"), b.alias("eb"), masks.counts_of_text(F.col("text")).alias("back"), masks.mask_area(a).alias("area"), masks.common_pixels(a, b).alias("common"),
        masks.mask_overlap(a, b, F.lit(False)).alias("iou"), masks.mask_overlap(a, b, F.lit(True)).alias("crowd"),
    ).collect()
    for (x, _), r in zip(pairs, rows, strict=True):
        p, q = pixels(r.ea), pixels(r.eb)
        assert r.back == x and r.area == len(p) and r.common == len(p & q)
        assert r.iou == pytest.approx(len(p & q) / len(p | q) if p | q else 0) and r.crowd == pytest.approx(len(p & q) / len(p) if p else 0)


def test_known_compressed_text(spark):
    got = spark.range(1).select(masks.counts_of_text(F.lit("52203")).alias("c"), masks.counts_of_text(F.lit("")).alias("e")).first()
    assert got.c == [5, 2, 2, 2, 5] and got.e == []


def test_polygons_against_pixel_centres(spark):
    rnd = random.Random(2)
    height, width = 17, 23
    shapes = [[[rnd.uniform(-3, 26) for _ in range(2 * rnd.randrange(3, 7))] for _ in range(rnd.randrange(1, 3))] for _ in range(40)] + [[[1.0, 1.0, 5.0, 1.0]], [[2.0, 3.0, 6.0, 3.0, 6.0, 8.0, 2.0, 8.0]]]
    df = spark.createDataFrame([(s,) for s in shapes], "s array<array<double>>")
    rows = df.select(masks.polygon_edges(F.col("s"), F.lit(height), F.lit(width)).alias("e")).collect()

    def inside(p: list[float], x: float, y: float) -> bool:
        points, hit = list(zip(p[::2], p[1::2], strict=True)), False
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
            hit ^= (x1 <= x) != (x2 <= x) and y1 + (x - x1) * (y2 - y1) / (x2 - x1) <= y
        return hit

    for s, r in zip(shapes, rows, strict=True):
        assert pixels(r.e) == {x * height + y for x in range(width) for y in range(height) if any(inside(p, x + 0.5, y + 0.5) for p in s)}
    assert pixels(rows[-1].e) == {x * height + y for x in range(2, 6) for y in range(3, 8)}
    assert r.e == sorted(set(r.e))


def boxes(seed: int, images: int = 12):
    rnd = random.Random(seed)
    truth, found = [], []
    for image in range(images):
        for category in "ab":
            own = []
            for k in range(rnd.randrange(5)):
                x, y, w, h = rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.choice([10, 40, 120]), rnd.choice([12, 50, 130])
                own.append([x, y, x + w, y + h])
                truth.append((image, category, k, own[-1], float(w * h), rnd.random() < 0.2 and image % 3 == 0))
            for k in range(rnd.randrange(7)):
                x, y, w, h = rnd.uniform(0, 60), rnd.uniform(0, 60), 30, 30
                box = [x, y, x + w, y + h]
                if own and rnd.random() < 0.8:
                    box = [v + rnd.uniform(-4, 4) for v in rnd.choice(own)]
                found.append((image, category, k, box, (box[2] - box[0]) * (box[3] - box[1]), rnd.choice([0.2, 0.5, 0.5, round(rnd.random(), 3)])))
    return truth, found


def iou(p, q, crowd=False):
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    common = max(w, 0) * max(h, 0)
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    return common / (area(p) if crowd else area(p) + area(q) - common)


def test_matching_equals_the_fold_over_boxes(spark):
    truth, found = boxes(3)
    t, p = spark.createDataFrame(truth, BOXES).withColumn("crowd", F.lit(False)), spark.createDataFrame(found, FOUND)
    keys = ["image", "category"]
    new = protocol.match_shapes(t, p, keys, protocol.box_overlap, 0.3)
    old = match_boxes(t.withColumnRenamed("shape", "box"), p.withColumnRenamed("shape", "box"), keys, 0.3)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
    assert protocol.match_shapes(t.limit(0), p.limit(0), keys, protocol.box_overlap).collect() == []


def test_sweep_equals_a_match_for_each_threshold(spark):
    truth, found = boxes(4, 30)
    t, p = spark.createDataFrame(truth, BOXES).withColumn("crowd", F.lit(False)), spark.createDataFrame(found, FOUND)
    keys, cuts = ["image", "category"], [0.0, 0.2, 0.35, 0.5, 0.8, 2.0]
    taken = protocol.hits(protocol.overlaps(t, p, keys, protocol.box_overlap, 0.5), keys)
    rows = {(r.category, r.threshold): r for r in protocol.score_sweep(t, p, taken, ["category"], cuts).collect()}
    assert len(rows) == 2 * len(cuts)
    for cut in cuts:
        once = protocol.match_shapes(t, p.where(F.col("score") >= cut), keys, protocol.box_overlap, 0.5)
        for want in match_summary(once, ["category"]).collect():
            got = rows[want.category, cut]
            assert all(got[c] == want[c] for c in ("gt", "predicted", "tp", "fp", "fn", "precision", "recall", "f1"))


def plain_protocol(truth, found):
    """The published procedure, image by image."""
    areas, limits = {"all": (0, 1e10), "small": (0, 1024), "medium": (1024, 9216), "large": (9216, 1e10)}, (1, 10, 100)
    cuts, recalls = np.linspace(0.5, 0.95, 10).round(2), np.linspace(0, 1, 101)
    ap, ar = defaultdict(list), defaultdict(list)
    for category in sorted({r[1] for r in truth} | {r[1] for r in found}):
        for name, (lo, hi) in areas.items():
            for cut in cuts:
                marks, wanted = [], 0
                for image in sorted({r[0] for r in truth} | {r[0] for r in found}):
                    gts = [(r[2], r[3], r[5], r[5] or not lo <= r[4] <= hi) for r in truth if r[:2] == (image, category)]
                    gts.sort(key=lambda g: (g[3], g[0]))
                    wanted += sum(not g[3] for g in gts)
                    dets = sorted((r for r in found if r[:2] == (image, category)), key=lambda r: (-r[5], r[2]))[:100]
                    used = set()
                    for rank, d in enumerate(dets, 1):
                        best, at = min(cut, 1 - 1e-10), None
                        for g in gts:
                            if g[0] in used and not g[2]:
                                continue
                            if at is not None and not at[3] and g[3]:
                                break
                            if iou(d[3], g[1], g[2]) >= best:
                                best, at = iou(d[3], g[1], g[2]), g
                        if at is not None:
                            used.add(at[0])
                        if (at is not None and at[3]) or (at is None and not lo <= d[4] <= hi):
                            continue
                        marks.append((-d[5], image, rank, int(at is not None)))
                if not wanted:
                    continue
                marks.sort()
                tp = np.cumsum([m[3] for m in marks])
                precision = tp / np.arange(1, len(tp) + 1)
                precision = np.maximum.accumulate(precision[::-1])[::-1] if len(tp) else precision
                places = np.searchsorted(tp / wanted, recalls)
                ap[name, cut].append(sum(precision[k] for k in places if k < len(tp)) / 101)
                for n in limits:
                    ar[name, n].append(sum(m[3] for m in marks if m[2] <= n) / wanted)
    mean = lambda x: round(float(np.mean(x)), 6) if len(x) else None
    of = lambda n, at=None: mean([v for (a, c), vs in ap.items() if a == n and at in (None, c) for v in vs])
    out = {"ap": of("all"), "ap50": of("all", 0.5), "ap75": of("all", 0.75)} | {f"ap_{a}": of(a) for a in ("small", "medium", "large")}
    return out | {f"ar_max_{n}": mean(ar["all", n]) for n in limits} | {f"ar_{a}": mean(ar[a, 100]) for a in ("small", "medium", "large")}


@pytest.mark.parametrize("seed", [5, 6])
def test_protocol(spark, seed):
    truth, found = boxes(seed, 25)
    got = protocol.protocol_summary(spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, FOUND), "image", "category", protocol.box_overlap)
    want = plain_protocol(truth, found)
    rows = {r["name"]: r["value"] for r in got.collect()}
    assert rows == pytest.approx(want, abs=2e-6) and rows.keys() == want.keys()
    assert rows["ap"] > 0.05 and rows["ap_small"] != rows["ap_large"]


def test_protocol_without_truths_or_detections(spark):
    truth, found = boxes(7, 4)
    t, p = spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, FOUND)
    none = protocol.protocol_summary(t.limit(0), p, "image", "category", protocol.box_overlap).collect()
    assert len(none) == 12 and all(r.value is None for r in none)
    zero = {r["name"]: r["value"] for r in protocol.protocol_summary(t, p.limit(0), "image", "category", protocol.box_overlap).collect()}
    assert zero["ap"] == zero["ar_max_100"] == 0


def test_masks_as_shapes_and_questions(spark):
    truth = spark.createDataFrame([(1, "cat", 0, [2, 4], None), (1, "dog", 0, [0, 3, 5, 3], False), (2, "cat", 0, [1, 1], None)], "question long, category string, idx long, counts array<long>, crowd boolean")
    found = spark.createDataFrame([(1, "cat", 0, [2, 3], 0.9), (1, "cat", 1, [2, 4], 0.8), (1, "dog", 0, None, 0.7), (3, "cow", 0, [0, 9], 0.5)], "question long, category string, idx long, counts array<long>, score double")
    shaped = lambda df: df.withColumn("shape", masks.edges(F.col("counts")))
    rows = protocol.match_shapes(shaped(truth), shaped(found), ["question", "category"], masks.mask_overlap, 0.5)
    got = {(r.question, r.category): tuple(r)[2:] for r in rows.collect()}
    assert got == {(1, "cat"): (1, 2, 1, 1, 0, 0.75), (1, "dog"): (1, 1, 0, 1, 1, 0.0), (2, "cat"): (1, 0, 0, 0, 1, 0.0), (3, "cow"): (0, 1, 0, 1, 0, 0.0)}
    one = protocol.question_summary(rows, "question").first()
    assert (one.questions, one.tp, one.fp, one.fn, one.micro_precision, one.micro_recall, one.mean_iou) == (3, 1, 3, 2, 0.25, 0.333333, 0.75)
    assert (one.macro_precision, one.macro_recall, one.macro_f1) == (round(0.333333 / 3, 6), round(0.5 / 3, 6), round(0.4 / 3, 6))


def plain_listings(evidence, wanted, axes):
    out = {}
    for s in axes["score"]:
        for m in axes["mask"]:
            sums = dict.fromkeys(("precision", "recall", "f1", "exact", "answered", "right"), 0.0)
            for image, goal in wanted.items():
                goal = set(goal or ())
                found = {c for i, c, score, mask in evidence if i == image and score is not None and score >= s and (m is None or (mask is not None and mask >= m))}
                hits = len(found & goal)
                sums["precision"] += hits / len(found) if found else 0
                sums["recall"] += hits / len(goal) if goal else 0
                sums["f1"] += 2 * hits / (len(found) + len(goal)) if found or goal else 0
                sums["exact"] += found == goal
                sums["answered"] += bool(found)
                sums["right"] += bool(found) and found == goal
            n, a = len(wanted), sums["answered"]
            out[s, m] = (n, a, a / n, sums["precision"] / n, sums["recall"] / n, sums["f1"] / n, sums["exact"] / n, sums["f1"] / a if a else 0, sums["right"] / a if a else 0)
    return out


def test_listing_policies_replayed(spark):
    rnd = random.Random(8)
    axes = {"score": [0.7, 0.1, 0.4, 0.4], "mask": [None, 0.5]}
    wanted = {i: rnd.sample("abcd", rnd.randrange(4)) if i else None for i in range(25)}
    evidence = [(rnd.randrange(27), rnd.choice("abcde"), rnd.choice([None, 0.05, 0.1, 0.4, 0.65, 0.9]), rnd.choice([None, 0.2, 0.5, 0.8])) for _ in range(120)]
    targets = spark.createDataFrame(list(wanted.items()), "image long, wanted array<string>")
    for rows in (evidence, []):
        df = spark.createDataFrame(rows, "image long, category string, score double, mask double")
        got = {(r.score, r.mask): tuple(r)[2:] for r in replay.sweep_listings(df, targets, "image", "category", "wanted", axes).collect()}
        want = plain_listings(rows, wanted, axes)
        assert got.keys() == want.keys() and len(got) == 6
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=2e-6)


def test_counts_of_marks_without_a_row_each(spark):
    truth, found = boxes(9, 20)
    t, p = spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, FOUND)
    marks = protocol.protocol_marks(t, p, "image", "category", protocol.box_overlap).groupBy("category", "area_name", "iou_at").agg(F.count(F.lit(1)), F.sum("hit"))
    counts = protocol.protocol_counts(t, p, "image", "category", protocol.box_overlap)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, marks.collect())) and marks.count() > 20


def test_sweep_takes_its_hits_without_a_join(spark):
    truth, found = boxes(10, 5)
    t, p = spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, FOUND)
    assert "Join" not in protocol.taken(t, p, ["image", "category"], protocol.box_overlap, 0.5)._jdf.queryExecution().optimizedPlan().toString()


def plain_marks(truth, found):
    """The marks of the published matching: category, image, rank, score, area, threshold and hit."""
    areas, out = {"all": (0, 1e10), "small": (0, 1024), "medium": (1024, 9216), "large": (9216, 1e10)}, []
    for key in sorted({r[:2] for r in found}):
        dets = sorted((r for r in found if r[:2] == key), key=lambda r: (-r[5], r[2]))[:100]
        for name, (lo, hi) in areas.items():
            gts = [(r[2], r[3], bool(r[5]), bool(r[5]) or not lo <= r[4] <= hi) for r in truth if r[:2] == key]
            gts.sort(key=lambda g: (g[3], g[0]))
            for cut in (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95):
                used = set()
                for rank, d in enumerate(dets, 1):
                    best, at = cut, None
                    for g in gts:
                        if g[0] in used and not g[2]:
                            continue
                        if at is not None and not at[3] and g[3]:
                            break
                        if iou(d[3], g[1], g[2]) >= best:
                            best, at = iou(d[3], g[1], g[2]), g
                    if at is not None:
                        used.add(at[0])
                    if at is None and lo <= d[4] <= hi or at is not None and not at[3]:
                        out.append((key[1], key[0], rank, d[5], name, cut, int(at is not None)))
    return sorted(out)


def crowded(seed: int):
    """Besides the usual boxes, a group of more detections than count, truths on the borders of areas and equal overlaps."""
    rnd = random.Random(seed)
    truth, found = boxes(seed, 8)
    sides = [32, 96, 32, 20, 60]
    truth += [(99, "a", k, [0.0, 0.0, float(w), float(w)], float(w * w), (None, False, False, True, None)[k]) for k, w in enumerate(sides)]
    for k in range(130):
        w = float(rnd.choice([*sides, 30, 50, 90]))
        found.append((99, "a", k, [0.0, 0.0, w, w], w * w, rnd.choice([0.1, 0.5, round(rnd.random(), 2)])))
    return truth, found


def test_marks_equal_the_plain_matching(spark):
    truth, found = crowded(11)
    t, p = spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, FOUND)
    rows = protocol.protocol_marks(t, p, "image", "category", protocol.box_overlap).collect()
    want = plain_marks(truth, found)
    assert sorted(map(tuple, rows)) == want and 90 < max(r[2] for r in want) <= 100


def test_counts_are_of_the_marks(spark, monkeypatch):
    truth, found = crowded(12)
    t, p = spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, FOUND)
    marks = protocol.protocol_marks
    for ranks in (100, 10, 1):  # counts of fewer marks follow from these marks
        monkeypatch.setattr(protocol, "protocol_marks", lambda *given, n=ranks: marks(*given).where(F.col("rank") <= n))
        want = defaultdict(lambda: [0, 0])
        for category, _, rank, _, area, cut, hit in plain_marks(truth, found):
            if rank <= ranks:
                want[category, area, cut][0] += 1
                want[category, area, cut][1] += hit
        got = protocol.protocol_counts(t, p, "image", "category", protocol.box_overlap).collect()
        assert {tuple(r)[:3]: list(r)[3:] for r in got} == want
