from __future__ import annotations

import random
from collections import Counter

import pytest

from visgauge.operators.live import coco_results
from visgauge.operators.selection import image_features, split_by_source


def tables(spark, images, annotations, categories=(1, 2)):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return frame([(i,) for i in images], "id long"), frame(annotations, "image_id long, category_id long, area double"), frame([(c,) for c in categories], "id long")


def test_image_features_and_their_faults(spark):
    good = [(1, 1, 10.0), (1, 1, 1024.0), (2, 2, None)]
    rows = {r.image_id: r.features for r in image_features(*tables(spark, [1, 2], good)).collect()}
    assert rows == {1: ["category:1", "size:medium", "size:small"], 2: ["category:2", "size:small"]}
    for images, annotations, said in (([1], good, "unknown image 2"), ([1, 2], [*good, (1, 9, 1.0)], "unknown category 9"), ([1, 2, 3], good, r"without annotations: \[3\]"), ([], [], "no images")):
        with pytest.raises(ValueError, match=said):
            image_features(*tables(spark, images, annotations))


def test_split_by_source(spark):
    rnd = random.Random(3)
    rows = [(f"{s}{i:02d}", s, rnd.sample(["small", "crowd", "tail"], rnd.randrange(1, 3)), [rnd.choice("abcd")]) for s, n in (("x", 20), ("y", 10), ("z", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, source string, tags array<string>, categories array<string>")
    got = split_by_source(df, "id", "source", "tags", "categories", 0.3, "s").collect()
    assert len(got) == len(rows) and Counter((r.source, r.split) for r in got) == {("x", "dev"): 6, ("x", "test"): 14, ("y", "dev"): 3, ("y", "test"): 7, ("z", "dev"): 1, ("z", "test"): 1}
    assert {r.id: r.split for r in got} == {r.id: r.split for r in split_by_source(df.repartition(5), "id", "source", "tags", "categories", 0.3, "s").collect()}
    in_dev = Counter(t for r in got if r.source == "x" and r.split == "dev" for t in r.tags)
    assert all(abs(in_dev[t] - 0.3 * n) < 1.5 for t, n in Counter(t for r in rows if r[1] == "x" for t in r[2]).items())
    with pytest.raises(ValueError, match="fewer than two"):
        split_by_source(df.where("id <> 'z00'"), "id", "source", "tags", "categories", 0.3, "s")
    with pytest.raises(ValueError, match="between"):
        split_by_source(df, "id", "source", "tags", "categories", 1.0, "s")


def test_a_box_without_area_is_no_result(spark):
    found = spark.createDataFrame([(1, "cat", [0.0, 0.0, 2.0, 0.0], 0.5), (1, "cat", [0.0, 0.0, 2.0, 1.0], 0.5)], "image_id long, class_name string, box array<double>, score double")
    rows = coco_results(found, spark.createDataFrame([(1, "cat")], "id int, name string")).collect()
    assert sorted(r.skipped or "" for r in rows) == ["", "invalid_bbox"]
