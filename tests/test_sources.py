from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from visgauge.functions.vocabulary import PREDICATES
from visgauge.sources import readers, sinks
from visgauge.streaming import runs


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": 1}\n\n{"id": 2, "x": "a"}\n')
    bad.write_text('{"id": 1}\n{"id": \n')
    assert [r.id for r in readers.read_jsonl(spark, str(good), "id long, x string").orderBy("id").collect()] == [1, 2]
    with pytest.raises(Exception, match="bad JSON line"):
        readers.read_jsonl(spark, str(bad), "id long, x string").collect()


@pytest.mark.parametrize("content", ['[{"id": 1},\n {"id": 2}]', '{"id": 1}\n{"id": 2}\n', '[\n{"id": 1}, {"id": 2}\n]'])
def test_records(spark, tmp_path, content):
    path = tmp_path / "records.json"
    path.write_text(content)
    assert sorted(r.id for r in readers.read_json_records(spark, str(path), "id long").collect()) == [1, 2]


def test_empty_records_are_an_error(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text("\n")
    with pytest.raises(readers.BadInput):
        readers.read_json_records(spark, str(path), "id long")


def test_candidates(spark, tmp_path):
    boxes, classes = tmp_path / "boxes.csv", tmp_path / "classes.csv"
    boxes.write_text("ImageID,LabelName,XMin,XMax,YMin,YMax,IsOccluded,IsTruncated,IsGroupOf\ni,/m/1,0.1,0.5,0.1,0.5,1,0,0\ni,/m/1,0.5,0.1,0.1,0.5,0,0,0\ni,/m/9,0.1,0.5,0.1,0.5,0,0,0\n")
    classes.write_text("/m/1,Dog\n")
    rows = readers.read_candidates(spark, str(boxes), str(classes)).collect()
    assert [(r.image, r.label, r.occluded, r.truncated) for r in rows] == [("i", "dog", True, False)]
    with pytest.raises(readers.BadInput, match="LabelName"):
        readers.read_table(spark, str(classes), ["LabelName"])


def test_graph(spark, tmp_path):
    relations, images = tmp_path / "r.json", tmp_path / "i.json"
    entity = {"object_id": 1, "name": "dog", "x": 1, "y": 2, "w": 3, "h": 4}
    relations.write_text(json.dumps([{"image_id": i, "relationships": [{"predicate": "Left of", "subject": entity, "object": entity}, {"predicate": "eats", "subject": entity, "object": entity}]} for i in (1, 2)]))
    images.write_text(json.dumps([{"image_id": 1, "coco_id": 7, "width": 10, "height": 10}, {"image_id": 2, "coco_id": None, "width": 10, "height": 10}]))
    rows = readers.read_graph(spark, str(relations), str(images), spark.createDataFrame([(7,)], "coco_id long"), PREDICATES).collect()
    assert [(r.image_id, r.predicate) for r in rows] == [(2, "to the left of")]


def test_ids(spark, tmp_path):
    path = tmp_path / "ids.json"
    path.write_text('{"image_ids": [3, 1, 2]}')
    assert [r.image_id for r in readers.read_ids(spark, str(path), "image_id").orderBy("place").collect()] == ["3", "1", "2"]
    path.write_text("[1, 1]")
    with pytest.raises(readers.BadInput):
        readers.read_ids(spark, str(path), "image_id")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"], {"k": 1})], "id long, names array<string>, m map<string,int>")
    flat = sinks.flat(rows).first()
    assert (flat.names, flat.m) == ("a;b", '{"k":1}')
    assert sinks.canonical_json(rows.select("names", "id")).first().value == '{"id":1,"names":["a","b"]}'
    sinks.write_csv(rows, str(tmp_path / "csv"))
    sinks.write_jsonl(rows, str(tmp_path / "jsonl"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    sinks.write_document(spark, {"b": 1, "a": 2}, str(tmp_path / "d" / "report.json"))
    assert (tmp_path / "d" / "report.json").read_text() == '{\n  "a": 2,\n  "b": 1\n}\n'


def test_runs(spark):
    samples = spark.range(4)
    answers = spark.createDataFrame([(0, 1, "x"), (0, 2, "y"), (3, 1, "z")], "id long, at long, answer string")
    assert sorted(r.id for r in runs.pending(samples, answers, "id").collect()) == [1, 2]
    assert {r.id: r.answer for r in runs.current(answers, "id", "at").collect()} == {0: "y", 3: "z"}
    assert tuple(runs.run_status(samples, answers, "id").first()) == (4, 2, "incomplete")


def test_follow_appends_each_key_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def go() -> None:
        metrics = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
        runs.follow(spark, str(source), "id long, answer string", out, str(tmp_path / "cp"), "id", metrics, str(tmp_path / "metrics"), "answer is not null").awaitTermination()

    (source / "a.json").write_text('{"id": 1, "answer": "x"}\n{"id": 2}\n')
    go()
    (source / "b.json").write_text('{"id": 1, "answer": "again"}\n{"id": 3, "answer": "y"}\n')
    go()
    assert {r.id: r.answer for r in spark.read.parquet(out).collect()} == {1: "x", 3: "y"}
    assert spark.read.json(str(tmp_path / "metrics")).first().n == 2
    assert spark.read.json(f"{out}_errors").first().id == 2
