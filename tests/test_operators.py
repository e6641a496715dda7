from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from visgauge.operators import candidates, datasets, dedup, detection, failures, live, metrics, paired, policy, questions, ranking, review, selection


def box_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union else 0.0


def random_boxes(seed, n, images=6):
    rnd = random.Random(seed)
    return [(rnd.randrange(images), rnd.choice("ab"), i, [float(x := rnd.randrange(20)), float(y := rnd.randrange(20)), float(x + rnd.randrange(1, 15)), float(y + rnd.randrange(1, 15))], rnd.randrange(5) / 5) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_match_boxes(spark, seed):
    truth, found = random_boxes(seed, 40), random_boxes(seed + 100, 60)
    t = spark.createDataFrame([r[:4] for r in truth], "image long, category string, idx long, box array<double>")
    p = spark.createDataFrame(found, "image long, category string, idx long, box array<double>, score double")
    expected = {}
    for key in {r[:2] for r in truth + found}:
        gts, used, tp = [r[3] for r in truth if r[:2] == key], set(), 0
        own = sorted((r for r in found if r[:2] == key), key=lambda r: (-r[4], r[2]))
        for r in own:
            best, at = 0.0, None
            for k, g in enumerate(gts):
                if k not in used and box_iou(g, r[3]) > best:
                    best, at = box_iou(g, r[3]), k
            if at is not None and best >= 0.3:
                used.add(at)
                tp += 1
        expected[key] = (len(gts), len(own), tp, len(own) - tp, len(gts) - tp)
    rows = detection.match_boxes(t, p, ["image", "category"], 0.3).collect()
    assert {(r.image, r.category): (r.gt, r.predicted, r.tp, r.fp, r.fn) for r in rows} == expected


def test_match_boxes_of_empty_sides(spark):
    schema = "image long, category string, idx long, box array<double>"
    some = spark.createDataFrame([(1, "a", 0, [0.0, 0.0, 1.0, 1.0])], schema)
    none = some.where("image < 0")
    missed = detection.match_boxes(some, none.withColumn("score", F.lit(1.0)), ["image", "category"]).first()
    extra = detection.match_boxes(none, some.withColumn("score", F.lit(1.0)), ["image", "category"]).first()
    assert (missed.fn, missed.fp, extra.fn, extra.fp) == (1, 0, 0, 1)


@pytest.mark.parametrize("seed", [4, 5])
def test_suppress(spark, seed):
    found = random_boxes(seed, 80)
    kept = set()
    for image in {r[0] for r in found}:
        stay = []
        for r in sorted((r for r in found if r[0] == image), key=lambda r: (-r[4], r[2])):
            if all(s[1] != r[1] or box_iou(s[3], r[3]) <= 0.4 for s in stay):
                stay.append(r)
        kept |= {(image, r[2]) for r in stay}
    rows = spark.createDataFrame(found, "image long, label string, idx long, box array<double>, score double")
    assert {tuple(r) for r in detection.suppress(rows, "image", 0.4).collect()} == kept


def test_average_precision(spark):
    hits = spark.createDataFrame([("a", 0.9, 1, True), ("a", 0.8, 2, False), ("a", 0.7, 3, True), ("b", 0.5, 4, False)], "g string, score double, id long, hit boolean")
    truths = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 0)], "g string, gt long")
    found = detection.average_precision(hits, "g", F.col("score"), [F.col("id")], F.col("hit"), truths).collect()
    assert {r.g: r.ap for r in found} == {"a": round((1 + 2 / 3) / 2, 6), "b": 0.0, "c": 0.0, "d": None}


def test_average_precision_in_ranges(spark):
    rnd = random.Random(6)
    rows = [(None if i % 4 == 3 else f"g{i % 4}", None if i % 97 == 0 else round(rnd.random(), 2), i, rnd.random() < 0.3) for i in range(4000)]
    truths = spark.createDataFrame([("g0", 400), ("g1", 300), ("g2", 350), (None, 320)], "g string, gt long")
    frame = spark.createDataFrame(rows, "g string, score double, id long, hit boolean")
    found = {r.g: r.ap for r in detection.average_precision(frame, "g", F.col("score"), [F.col("id")], F.col("hit"), truths, ranges=8).collect()}
    for g, gt in (("g0", 400), ("g1", 300), ("g2", 350), (None, 320)):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[1] if r[1] is not None else -1), r[2]))
        hits, curve = 0, []
        for n, r in enumerate(own, 1):
            hits += r[3]
            curve.append((hits / n, r[3]))
        best, area = 0.0, 0.0
        for p, hit in reversed(curve):
            best = max(best, p)
            area += best * hit
        assert found[g] == pytest.approx(area / gt, abs=2e-6)


def test_largest_relation(spark):
    rows = [(1, 0, "dog", [0.6, 0.4, 0.9, 0.7], 0.09), (1, 1, "cat", [0.1, 0.4, 0.3, 0.6], 0.04), (1, 2, "cat", [0.0, 0.0, 0.1, 0.1], 0.01), (2, 0, "a", [0.1, 0.1, 0.2, 0.2], 0.01), (2, 1, "b", [0.15, 0.15, 0.2, 0.2], 0.0025)]
    found = detection.largest_relation(spark.createDataFrame(rows, "image long, idx int, category string, box array<double>, area double"), "image").collect()
    assert [(r.image, r.subject, r.predicate, r.object) for r in found] == [(1, "dog", "to the right of", "cat")]


@pytest.mark.parametrize("within", [0, 1, 4])
def test_near_pairs(spark, within):
    rnd = random.Random(9)
    base = [rnd.getrandbits(63) for _ in range(30)]
    values = base + [v ^ sum(1 << b for b in rnd.sample(range(60), rnd.randrange(6))) for v in base] + [-1, -2]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, s long")
    expected = {(i, j, d) for (i, a), (j, b) in itertools.combinations(enumerate(values), 2) if (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= within}
    found = [tuple(r) for r in dedup.near_pairs(rows, "id", "s", within).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected


def test_duplicate_status(spark):
    rows = spark.createDataFrame([(1, "x", False), (2, "x", False), (3, "r", True), (4, "y", False), (5, "z", True), (6, "w", False)], "id long, d string, bad boolean")
    reference = spark.createDataFrame([("r",)], "h string")
    near = spark.createDataFrame([(4, 2)], "left long, right long")
    found = dedup.duplicate_status(rows, "id", "d", reference, "h", near, F.col("bad")).collect()
    assert {r.id: r.status for r in found} == {1: "accepted", 2: "exact_copy", 3: "exact_reference", 4: "near_duplicate", 5: "invalid", 6: "accepted"}


def test_binary_and_balanced(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True), (None, True)], "p boolean, t boolean")
    m = metrics.binary_metrics(rows, F.col("p"), F.col("t")).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.n, m.accuracy) == (1, 1, 1, 1, 4, 0.5)
    answers = spark.createDataFrame([("above", "above"), ("above", None), ("above", "above"), ("below", "above")], "t string, p string")
    b = metrics.balanced_accuracy(answers, "t", "p").first()
    assert (b.n, b.accuracy, b.balanced_accuracy, b.majority_baseline) == (4, 0.5, 0.333333, 0.75)
    assert {(r.target, r.prediction): r.n for r in metrics.confusion(answers, "t", "p").collect()}[("above", "invalid")] == 1
    empty = metrics.binary_metrics(rows.limit(0), F.col("p"), F.col("t")).first()
    assert (empty.n, empty.f1) == (0, 0.0)


def test_rescue(spark):
    answers = spark.createDataFrame([(1, "no"), (2, "no"), (3, "no"), (4, "yes"), (5, "yes")], "id long, answer string")
    evidence = spark.createDataFrame([(1, 0.9), (1, 0.4), (2, 0.4), (4, 0.4)], "id long, score double")
    found = {r.id: (r.final_answer, r.status) for r in policy.rescue(answers, evidence, "id", "answer", policy.Gate(promotion=0.5)).collect()}
    assert [found[i][0] for i in range(1, 6)] == ["yes", "no", "no", "yes", "yes"]
    assert found[2][1] == "negative_preserved_below_promotion_threshold"
    with pytest.raises(ValueError, match="promotion"):
        policy.Gate(score=0.5, promotion=0.4)


def test_judge_falls_back_to_the_baseline(spark):
    schema = "policy_id string, accuracy double, f1 double, precision double, helped long, harmed long"
    worse = spark.createDataFrame([("base", 0.8, 0.8, 0.8, 0, 0), ("p", 0.7, 0.9, 0.9, 3, 1)], schema)
    better = spark.createDataFrame([("base", 0.8, 0.8, 0.8, 0, 0), ("p", 0.9, 0.9, 0.9, 3, 1), ("o", 0.9, 0.9, 0.9, 3, 1)], schema)
    chosen = [[r.policy_id for r in policy.judge(df, F.col("policy_id") == "base").where("chosen").collect()] for df in (worse, better)]
    assert chosen == [["base"], ["o"]]


def test_ranking(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 3, 9), ("a", 4, 7)], "g string, id long, v long")
    order = [(r.g, r.id) for r in ranking.round_robin(rows, "g", [F.col("id")], 3).collect()]
    assert order == [("a", 1), ("b", 3), ("a", 2)]
    assert {(r.g, r.v) for r in ranking.last_wins(rows, ["g"], [F.col("id")]).collect()} == {("a", 7), ("b", 9)}
    assert ranking.constrained_best(rows, F.col("v") < 9, [F.desc("v")]).first().id == 4
    with pytest.raises(Exception, match="no row meets"):
        ranking.constrained_best(rows, F.col("v") > 99, [F.desc("v")]).collect()


def test_joining_runs_that_differ_is_an_error(spark):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(2).withColumn("x", F.lit(2))
    assert paired.join_runs(b, b, "id").count() == 2
    with pytest.raises(Exception, match="lacks or repeats"):
        paired.join_runs(a, b, "id").collect()


def test_split_is_stable_and_complete(spark):
    rows = spark.createDataFrame([(i, "en" if i % 3 else "fr") for i in range(60)] + [(99, "de")], "id long, lang string")
    one = datasets.stratified_split(rows, "id", ["lang"], 0.25, "s")
    two = datasets.stratified_split(rows.repartition(7), "id", ["lang"], 0.25, "s")
    assert sorted(map(tuple, one.select("id", "split").collect())) == sorted(map(tuple, two.select("id", "split").collect()))
    assert {(r.lang, r.split): r["count"] for r in one.groupBy("lang", "split").count().collect()} == {("en", "dev"): 10, ("en", "test"): 30, ("fr", "dev"): 5, ("fr", "test"): 15, ("de", "test"): 1}
    check = datasets.split_check(rows, [one.where("split = 'dev'"), one], "id").first()
    assert (check.overlap, check.missing, check.unknown) == (15, 0, 0)


def test_negatives_are_absent_and_of_the_same_group(spark):
    vocabulary = spark.createDataFrame([("cat", "animal"), ("dog", "animal"), ("cup", "thing")], "category string, kind string")
    here = spark.createDataFrame([(1, "cat"), (2, "cat"), (2, "dog"), (3, "cup")], "sample long, category string")
    found = datasets.negatives(here, vocabulary, "sample", "category", "kind", "s").collect()
    assert [(r.sample, r.category, r.negative) for r in found] == [(1, "cat", "dog")]


def test_failures(spark):
    rows = spark.createDataFrame([(1, True, False), (2, True, True), (3, None, False)], "id long, a boolean, b boolean")
    f = failures.flagged(rows, {"a": F.col("a"), "b": F.col("b")}, {"a": 2, "b": 3})
    assert [(r.id, r.severity, r.flags) for r in failures.worst(f, "id", 5).collect()] == [(2, 5.0, ["a", "b"]), (1, 2.0, ["a"])]


def test_thresholds_swept_by_cells_and_row_by_row(spark):
    rnd = random.Random(11)
    rows = spark.createDataFrame([(rnd.choice([None, 0.1, 0.5, 0.7]), rnd.random(), rnd.choice([True, False, None])) for _ in range(300)], "a double, b double, hit boolean")
    axes = {"x": [0.1, 0.5, 0.9], "y": [0.0, 0.5]}
    candidates = policy.grid(spark, **axes)
    one = policy.sweep_thresholds(rows, candidates, {"x": F.col("a"), "y": F.col("b")}, axes, F.col("hit"))
    two = policy.sweep(rows, candidates, F.expr("coalesce(a >= x and b >= y, false)"), F.expr("coalesce(hit, false)"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(one.columns).collect()))


@pytest.mark.parametrize(("within", "equal"), [(3, 1), (4, 2), (2, 3)])
def test_near_pairs_of_repeated_signatures(spark, within, equal):
    rnd = random.Random(12)
    base = [rnd.getrandbits(64) - (1 << 63) for _ in range(12)]
    rows = [(i, base[i % 12] ^ sum(1 << b for b in rnd.sample(range(63), rnd.randrange(5)))) for i in range(80)] + [(100, base[0]), (101, base[0]), (102, None)]
    found = sorted(tuple(r) for r in dedup.near_pairs(spark.createDataFrame(rows, "id long, s long"), "id", "s", within, equal).collect())
    apart = {(a, b): ((s ^ t) & ((1 << 64) - 1)).bit_count() for (a, s), (b, t) in itertools.combinations(rows, 2) if s is not None and t is not None}
    assert found == sorted((*p, d) for p, d in apart.items() if d <= within)


def test_null_strata_are_kept(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "id long, lang string")
    split = datasets.stratified_split(rows, "id", ["lang"], 0.3, "s")
    assert {(r.lang, r.split): r["count"] for r in split.groupBy("lang", "split").count().collect()} == {("a", "dev"): 3, ("a", "test"): 7, (None, "dev"): 3, (None, "test"): 7}


def greedy_split(features, dev_size, salt, protect):
    """The same choice, row by row."""
    order = {k: hashlib.sha256(f"{salt}\0{k}".encode()).hexdigest() for k in features}
    total = Counter(f for fs in features.values() for f in fs)
    category = {f for f in total if f.startswith("category:")}
    target = {f: max(1, c * dev_size / len(features)) if f in category and c > 1 else c * dev_size / len(features) for f, c in total.items()}
    open_, single = {f for f in category if total[f] > 1}, {f for f in category if total[f] == 1}
    picked, seen = [], Counter()
    for slot in range(1, dev_size + 1):

        def score(k, slot=slot):
            own = features[k]
            error = sum((seen[f] + (f in own) - target[f] * slot / dev_size) ** 2 / total[f] for f in total)
            return len(own & single) if protect else 0, round(-sum(1 / total[f] for f in own & open_), 9), round(error, 7), order[k]

        best = min((k for k in features if k not in picked), key=score)
        picked.append(best)
        seen.update(features[best])
        open_ -= features[best]
    return set(picked)


@pytest.mark.parametrize("protect", [True, False])
def test_multilabel_split(spark, protect):
    rnd = random.Random(31)
    features = {k: {f"category:{rnd.choice('abcdefgh')}" for _ in range(rnd.randrange(1, 4))} | {f"size:{rnd.choice('sml')}"} for k in range(60)}
    features |= {100: {"category:only", "size:s"}, 101: {"category:rare", "size:l"}, 102: {"category:rare", "size:m"}}
    df = spark.createDataFrame([(k, sorted(fs)) for k, fs in features.items()], "id long, f array<string>")
    found = selection.multilabel_split(df, "id", "f", 12, "s", protect_singletons=protect).collect()
    assert len(found) == len(features)
    assert {r.id for r in found if r.split == "dev"} == greedy_split(features, 12, "s", protect)
    if protect:
        assert 100 not in {r.id for r in found if r.split == "dev"}
    with pytest.raises(ValueError, match="dev_size"):
        selection.multilabel_split(df, "id", "f", 63, "s")


def test_diverse_selection(spark):
    rnd = random.Random(32)
    rows = [(k, rnd.choice("xy"), float(rnd.randrange(4)), sorted(rnd.sample(["t1", "t2", "t3"], rnd.randrange(3))), sorted(rnd.sample("abcde", rnd.randrange(1, 4)))) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, g string, score double, tags array<string>, cats array<string>")
    quotas = {"x": 7, "y": 4, "z": 0}
    expected = {}
    for g, quota in quotas.items():
        left, tags, cats = [r for r in rows if r[1] == g], Counter(), Counter()
        for rank in range(1, quota + 1):
            worth = lambda r: round(r[2] + sum(1 / (1 + tags[t]) for t in r[3]) + 0.2 * sum(1 / (1 + cats[c]) for c in r[4]), 9)  # noqa: B023, E731
            best = min(left, key=lambda r: (-worth(r), hashlib.sha256(f"s\0{r[0]}".encode()).hexdigest()))
            left.remove(best)
            tags.update(best[3])
            cats.update(best[4])
            expected[best[0]] = rank
    found = selection.diverse_selection(df, "id", "g", "score", "tags", "cats", quotas, "s").collect()
    assert {r.id: r["rank"] for r in found} == expected
    with pytest.raises(ValueError, match="rows of the"):
        selection.diverse_selection(df, "id", "g", "score", "tags", "cats", {"x": 60}, "s")


def test_contrastive_cascade_refuses_what_is_incomplete(spark):
    baseline = spark.createDataFrame([(1, "no", "yes"), (2, "Yes", "no")], "id long, prediction string, gt_answer string")
    jobs = spark.createDataFrame([(1, "k", "dog", ["cat", "dog", "none"])], "id long, v3_key string, object string, options array<string>")
    reviews = spark.createDataFrame([("k", " Dog ")], "v3_key string, answer string")
    found = {r.id: (r.final_answer, r.status, r.correction) for r in review.contrastive_cascade(baseline, jobs, reviews).collect()}
    assert found == {1: ("yes", "promoted_by_contrastive_target_match", "beneficial"), 2: ("yes", "positive_preserved_without_negative_recheck", "unchanged")}
    with pytest.raises(Exception, match="no review"):
        review.contrastive_cascade(baseline, jobs, reviews.limit(0)).collect()
    with pytest.raises(Exception, match="repeated"):
        review.contrastive_cascade(baseline, jobs.union(jobs), reviews).collect()


def test_ontology_faults(spark):
    groups = spark.createDataFrame([("animal", "Cat"), ("animal", "dog"), ("pet", "cat"), ("animal", "dog"), ("food", "pie")], "g string, c string")
    expected = spark.createDataFrame([("cat",), ("dog",), ("cow",)], "category string")
    assert sorted(map(tuple, review.ontology_faults(groups, "g", "c", expected).collect())) == [("missing", "cow"), ("repeated", "dog"), ("several_groups", "cat"), ("unknown", "pie")]


def test_evidence_is_judged_by_what_is_expected(spark):
    box = [0.0, 0.0, 10.0, 10.0]
    samples = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True)], "id long, is_correct boolean")
    truth = spark.createDataFrame([(1, "cat", 0, box), (1, "dog", 1, box), (2, "cat", 0, box), (4, "cat", 0, box)], "id long, category string, idx long, box array<double>")
    found = spark.createDataFrame([(1, "cat", 0, box, 0.9), (2, "dog", 0, box, 0.9), (3, "cat", 0, box, 0.9), (4, "cat", 0, box, 0.9)], "id long, category string, idx long, box array<double>, score double")
    scored = {r.id: (r.evidence_required, r.evidence_supported, r.evidence_complete, r.success, r.complete_success) for r in live.evidence_success(samples, truth, found).collect()}
    assert scored == {1: (True, True, False, True, False), 2: (True, False, False, False, False), 3: (False, False, False, False, False), 4: (True, True, True, False, False), 5: (False, True, True, True, True)}


def test_coco_exchange(spark):
    categories = spark.createDataFrame([(7, "cat"), (8, "dog")], "id int, name string")
    annotations = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 8)], "image_id long, category_id long")
    questions = spark.createDataFrame([(1, "object_listing", ["cat"]), (2, "object_existence", ["cat"]), (3, "object_listing", ["cat", "dog"])], "image_id long, task_type string, categories array<string>")
    kept = live.oracle_annotations(annotations, categories, questions)
    assert sorted((r.image_id, r.category_id) for r in kept.collect()) == [(1, 7), (3, 8)]
    assert tuple(live.filtered_report(annotations, kept).first()) == (4, 2, 2, 0.5)
    with pytest.raises(Exception, match="no category"):
        live.oracle_annotations(annotations, categories, questions.union(spark.createDataFrame([(1, "object_listing", ["cow"])], questions.schema))).collect()
    found = spark.createDataFrame([(1, "Cat", [1.0, 2.0, 4.00004, 8.0], 0.5), (1, "cow", [1.0, 2.0, 3.0, 4.0], 0.5), (1, "dog", [5.0, 2.0, 3.0, 4.0], 0.5), (1, "dog", [5.0, 2.0], 0.5), (1, "dog", None, 0.5)], "image_id long, class_name string, box array<double>, score double")
    results = live.coco_results(found, categories).collect()
    assert Counter(r.skipped for r in results) == {None: 1, "unmapped_label": 1, "invalid_bbox": 3}
    assert [(r.category_id, r.bbox) for r in results if r.skipped is None] == [(7, [1.0, 2.0, 3.0, 6.0])]


def test_canonical_targets(spark):
    df = spark.createDataFrame([(1, ["Cats", "the cat", "red  Car", " ", "cat and dog"]), (2, [])], "id long, targets array<string>")
    found = {r.id: r.canonical for r in live.canonical_targets(df, "id", "targets").collect()}
    assert found == {1: ["car", "cat", "cat and dog"], 2: []}


def test_names_of_entities(spark):
    rows = [(["dog.n.01"], ["Puppy"], "x", "dog"), ([], ["Traffic_Light", "y"], None, "traffic light"), (None, None, "Man's", "man"), (None, [], None, "")]
    df = spark.createDataFrame(rows, "synsets array<string>, names array<string>, name string, expected string")
    found = df.select(candidates.entity_name(F.col("synsets"), F.col("names"), F.col("name")).alias("n"), "expected").collect()
    assert [r.n for r in found] == [r.expected for r in found]
    box = spark.range(1).select(candidates.unit_box(*[F.lit(v) for v in (-5, 10, 20, 200, 100, 100)]).alias("b"), candidates.unit_box(*[F.lit(v) for v in (0, 0, 0, 5, 100, 100)]).alias("none")).first()
    assert (box.b, box.none) == ([0.0, 0.1, 0.15, 1.0], None)


def test_relations_beyond_doubt(spark):
    entities = [(1, "a", "dog", 0.5), (1, "b", "dog", 0.2), (1, "c", "cat", 0.1), (1, "d", "cat", 0.1), (1, "e", "cow", 0.3), (2, "a", "dog", 0.1), (1, "a", "dog", 0.5)]
    relations = [(1, "a", "above", "e"), (1, "a", "above", "e"), (1, "b", "above", "e"), (1, "c", "above", "e"), (1, "e", "below", "a"), (1, "a", "above", "b"), (1, "a", None, "e"), (2, "a", "above", "e")]
    found = candidates.safe_relations(spark.createDataFrame(entities, "image long, entity string, category string, area double"), spark.createDataFrame(relations, "image long, subject string, predicate string, object string"))
    assert sorted((r.image, r.subject, r.predicate, r.object, r.subject_rule, r.object_rule) for r in found.collect()) == [
        (1, "a", "above", "e", "largest_instance", "unique_category"), (1, "e", "below", "a", "unique_category", "largest_instance"),
    ]


def test_box_candidates(spark):
    rows = [(1, 0, "dog", [0.6, 0.4, 0.9, 0.7], 0.09, False), (1, 1, "cat", [0.1, 0.4, 0.3, 0.6], 0.04, False), (1, 2, "crowd", [0.0, 0.0, 1.0, 1.0], 1.0, True), (2, 0, "cow", [0.1, 0.1, 0.2, 0.2], 0.001, False)]
    objects = spark.createDataFrame(rows, "image long, idx int, category string, box array<double>, area double, group_of boolean").withColumns({"occluded": F.lit(True), "truncated": F.lit(None).cast("boolean")})
    found = candidates.box_candidates(objects).collect()
    assert [(r.image, r.categories, r.subject, r.predicate, r.object, r.n_objects, r.n_relations) for r in found] == [(1, ["cat", "crowd", "dog"], "dog", "to the right of", "cat", 3, 1)]
    assert set(found[0].tags) >= {"occluded", "group_of", "spatial_relation"} and "truncated" not in found[0].tags


def test_questions_refuse_what_is_incomplete(spark):
    asked = spark.createDataFrame([("a", "spatial_relation", "q", ["x"], ("largest", "y"))], "source string, task_type string, question string, categories array<string>, rules struct<subject:string,object:string>")
    policies = spark.createDataFrame([("a", "v2", True), ("b", "v3", False)], "source string, variant string, passed boolean")
    with pytest.raises(Exception, match="two categories"):
        questions.source_prompts(asked, policies).collect()
    with pytest.raises(Exception, match="no accepted"):
        questions.source_prompts(asked.withColumn("source", F.lit("b")), policies).collect()
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (2, "b", 3)], "id long, s string, o long")
    assert questions.select_records(rows, "id", "s", "o", ["a"], 1).collect() == [(1, "a", 1)]
    with pytest.raises(Exception, match="repeated"):
        questions.select_records(rows, "id", "s", "o", ["a", "b"]).collect()
    with pytest.raises(Exception, match="no rows"):
        questions.select_records(rows, "id", "s", "o", ["a", "c"]).collect()
    answers = spark.createDataFrame([("q", "Yes", "cat"), ("q", "no", "cat")], "query_key string, prediction string, object string")
    with pytest.raises(Exception, match="differ"):
        questions.review_jobs(answers, spark.createDataFrame([("q", 0, 0.5)], "query_key string, idx long, score double"), F.col("object")).collect()


def test_scores_of_masks_and_limits(spark):
    df = spark.createDataFrame([(0.5, 0.4, [(1, "rle")]), (0.5, None, [])], "score double, mask double, found array<struct<idx:int,segmentation:string>>")
    modes = [questions.segmentation_score(F.col("score"), F.col("mask"), m).alias(m) for m in ("detector", "mask", "product")]
    assert [tuple(r) for r in df.select(*modes).collect()] == [(0.5, 0.4, 0.2), (0.5, 0.5, 0.25)]
    assert df.select(questions.without_masks(F.col("found")).alias("f")).first().f == [(1,)]
    assert df.select(questions.target_limit(F.lit("task_aware_coco")).alias("n")).first().n == 80
    with pytest.raises(Exception, match="unknown prompt policy"):
        df.select(questions.target_limit(F.lit("x"))).collect()
