from __future__ import annotations

import math

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from visgauge.functions import boxes, hashing, stats, text
from visgauge.operators.scoring import score_answers, set_scores


def one(spark: SparkSession, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "strict", "official"),
    [("Yes.", "yes", "yes"), ("no, it is not", "no", "no"), ("yes and no", None, "no"), ("Perhaps", None, "yes"), ("NO", "no", "yes"), ("", None, "yes"), ("Well. No", "no", "yes"), (None, None, "yes")],
)
def test_answers(spark, said, strict, official):
    rows = spark.createDataFrame([(said,)], "a string").select(text.parse_yes_no(F.col("a")), text.official_answer(F.col("a"))).first()
    assert tuple(rows) == (strict, official)


def test_relations(spark):
    rows = spark.createDataFrame([("It is left of it.",), ("beneath",), ("above and below",), ("near",), (None,)], "a string")
    assert [r[0] for r in rows.select(text.parse_relation(F.col("a"))).collect()] == ["to the left of", "below", None, None, None]


def test_longest_category_counts(spark):
    rows = spark.createDataFrame([("A hot dog, two sofas and a Traffic_light",), ("nothing",), (None,)], "a string")
    assert [r[0] for r in rows.select(text.extract_categories(F.col("a"))).collect()] == [["couch", "hot dog"], [], None]


def test_set_scores(spark):
    s = one(spark, set_scores(F.array(*map(F.lit, "abx")), F.array(*map(F.lit, "ab"))))
    assert (s.precision, s.recall, s.f1, s.exact_match) == (0.666667, 1.0, 0.8, False)
    empty = one(spark, set_scores(F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert (empty.precision, empty.f1, empty.exact_match) == (0.0, 0.0, True)


def test_scores_by_task(spark):
    rows = spark.createDataFrame(
        [("object_existence", "Yes", "yes", []), ("spatial_relation", "on top of it", "above", []), ("object_listing", "cat and dog", "", ["cat"]), ("other", "Two", "two", [])],
        "task_type string, prediction string, gt_answer string, categories array<string>",
    )
    found = [(r.evaluation.score, r.evaluation.is_correct) for r in score_answers(rows).collect()]
    assert found == [(1.0, True), (1.0, True), (0.666667, False), (1.0, True)]


@pytest.mark.parametrize(("b", "c"), [(0, 0), (3, 19), (6, 11), (5, 5), (0, 7), (400, 500), (3000, 3100)])
def test_mcnemar(spark, b, c):
    n, least = b + c, min(b, c)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(least + 1))
    expected = 1.0 if n == 0 else min(1.0, 2 * tail)
    assert one(spark, stats.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(expected, abs=2e-6)


def test_mcnemar_published(spark):
    assert one(spark, stats.mcnemar(F.lit(3), F.lit(19))) == 0.000855
    assert one(spark, stats.mcnemar(F.lit(6), F.lit(11))) == 0.332306


def test_percentile_and_ratio(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    assert rows.agg(stats.exact_percentile(F.col("v"), 0.95)).first()[0] == 9.1
    assert one(spark, stats.ratio(F.lit(1), F.lit(0))) == 0.0


def test_boxes(spark):
    a, b = F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), F.array(*map(F.lit, (5.0, 5.0, 15.0, 15.0)))
    assert one(spark, boxes.iou(a, b)) == pytest.approx(25 / 175)
    assert one(spark, boxes.sides(boxes.corners(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))))) == [1, 2, 3, 4]
    assert one(spark, boxes.sides(F.array(*map(F.lit, (1.0, 2.0, 1.0, 4.0))))) is None
    assert [one(spark, boxes.size_name(F.lit(v))) for v in (1023.0, 1024.0, 9216.0)] == ["small", "medium", "large"]
    assert one(spark, boxes.normalized(F.array(*map(F.lit, (-10.0, 0.0, 60.0, 50.0))), F.lit(100.0), F.lit(100.0))) == [0, 0, 0.5, 0.5]
    crop = one(spark, boxes.crop_around(F.array(*map(F.lit, (90.0, 90.0, 100.0, 100.0))), F.lit(100), F.lit(100), 0.25, 32))
    assert crop == [68, 68, 100, 100]


def test_hashes(spark):
    assert one(spark, hashing.hamming(F.lit("ffffffffffffffff"), F.lit("fffffffffffffffc"))) == 2
    rows = spark.createDataFrame([("a",), ("b",)], "v string")
    digest = [r.agg(F.sum(hashing.row_digest(F.col("v")))).first()[0] for r in (rows, rows.orderBy(F.desc("v")))]
    assert digest[0] == digest[1]


def test_texts(spark):
    rows = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("x {\"a\": 2} y",), ("{bad",), (None,)], "a string")
    assert [tuple(r[0]) for r in rows.select(text.recover_json(F.col("a"))).collect()] == [('{"a": 1}', "fenced"), ('{"a": 2}', "embedded"), (None, "none"), (None, "none")]
    assert one(spark, text.grounding_prompt(F.array(*map(F.lit, ("dog", " cat ", "dog", ""))))) == "cat. dog."
    assert one(spark, text.grounding_prompt(F.array().cast("array<string>"))) == ""
    assert one(spark, text.manual_targets(F.lit("Red cup, dog;\n red cup. "), 5)) == ["red cup", "dog"]
    assert one(spark, text.portable_path(F.lit("C:\\p\\run\\a.json"), "C:\\p")) == "run/a.json"
    assert one(spark, text.question_entities(F.lit("Where is the dog relative to the red cup?"), F.lit("spatial_relation"))) == ["dog", "red cup"]
    assert [one(spark, text.pluralize(F.lit(w))) for w in ("bus", "berry", "key", "dish", "cup")] == ["buses", "berries", "keys", "dishes", "cups"]
    assert [one(spark, text.pluralize(F.lit(w))) for w in ("", "  ", "y", "traffic  light", "hay", "x y")] == ["", "  ", "ys", "traffic lights", "hays", "x ys"]
    assert [one(spark, text.threshold_slug(F.lit(x))) for x in (0.3, 1234.0)] == ["0p30", "1234p00"]
    assert one(spark, text.portable_path(F.lit("/home/other/p/run/a.json"), "C:\\q\\p")) == "run/a.json"
    assert one(spark, text.portable_path(F.lit("/elsewhere\\a.json"), "/q/p")) == "/elsewhere/a.json"
    assert one(spark, hashing.key(F.lit(None), F.lit("a"))) != one(spark, hashing.key(F.lit("a"), F.lit(None)))


def test_overlapping_names(spark):
    names = ["hot", "hot dog", "dog house big", "cat"]
    said = {"a hot dog house big": ["dog house big", "hot"], "hot dogs and cats": ["cat", "hot dog"], "scat hotel": [], "hot": ["hot"]}
    assert {t: one(spark, text.extract_categories(F.lit(t), names, {})) for t in said} == said
    assert one(spark, text.safe_label(F.lit(" !! "))) == "object"
    with pytest.raises(Exception, match="needs a phrase"):
        one(spark, text.normalize_prompt(F.lit(" . ; ")))


def test_mcnemar_of_any_count(spark):
    from visgauge.functions.stats import mcnemar

    def exact(a: int, b: int) -> float:
        n, k = a + b, min(a, b)
        term = total = math.comb(n, k)
        for i in range(k, 0, -1):
            term = term * i // (n - i + 1)
            total += term
        return min(1.0, 2 * total / 2**n)

    pairs = [(0, 0), (3, 5), (4000, 4100), (4000, 4300), (4200, 4300), (5000, 5003), (5000, 5000), (5200, 4900), (20_000, 20_301), (30_000, 30_400), (6000, 5200), (9000, 30)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for (a, b), r in zip(pairs, df.select(mcnemar(F.col("a"), F.col("b"), 9).alias("p")).collect(), strict=True):
        assert r.p == pytest.approx(exact(a, b), abs=1e-7), (a, b)
    huge = spark.createDataFrame([(5 * 10**9, 5 * 10**9 + 160_000), (3 * 10**9, 3 * 10**9), (10**10, 3)], "a long, b long").select(mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    assert huge[0].p == pytest.approx(math.erfc(160_000 / math.sqrt(10**10 + 160_000) / math.sqrt(2)), abs=1e-5) and huge[1].p == 1.0 and huge[2].p == 0.0


def test_json_nested_without_end(spark):
    from visgauge.functions.text import recover_json

    texts = ['{"a":' * 100_000, "[" * 100_000, 'so: {"a": 1}', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(recover_json(F.col("t")).alias("r")).collect()
    assert [r.r.source for r in rows] == ["none", "none", "embedded", "none"]
