"""JSON arrays by byte ranges, cut at every place."""

from __future__ import annotations

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from visgauge.sources.json_arrays import BadArray, read_json_array
from visgauge.sources.readers import read_json_records

SCHEMA = "id long, name string, tags array<string>, inner struct<x:double>"


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def records(seed: int, n: int) -> list[dict]:
    rnd = random.Random(seed)
    bits = ["}", "{", "[", "]", ",", '"', "\\", "},{", '"},', "é", "日", "a", " ", "\n", "\\\""]
    text = lambda: "".join(rnd.choices(bits, k=rnd.randrange(12)))
    return [{"id": i, "name": text() * rnd.choice([1, 1, 1, 40]), "tags": [text() for _ in range(rnd.randrange(3))], "inner": {"x": i / 2} if i % 3 else None} for i in range(n)]


def plain(rows):
    return sorted((r.id, r.name, r.tags, None if r.inner is None else r.inner.x) for r in rows)


@pytest.mark.parametrize("form", [{}, {"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_arrays_in_small_ranges(spark, tmp_path, small_ranges, form):
    found = records(len(form), 60)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(found, **form) + "\n" * len(form), encoding="utf-8")
    rows = read_json_array(spark, str(path), SCHEMA)
    assert rows.rdd.getNumPartitions() > 10
    assert plain(rows.collect()) == sorted((r["id"], r["name"], r["tags"], r["inner"] and r["inner"]["x"]) for r in found)


def test_small_and_empty_arrays(spark, tmp_path):
    for k, (text, n) in enumerate([("[]", 0), (" [ \n ] ", 0), ('[{"id":1}]', 1), ('\n[ {"id":1} , {"id":2} ]\n', 2), ("[{}]", 1)]):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert len(read_json_array(spark, str(path), SCHEMA).collect()) == n
        assert read_json_records(spark, str(path), SCHEMA).count() == n


@pytest.mark.parametrize("ranges", [False, True])
@pytest.mark.parametrize("text", ['[{"id":1}', '[{"id":1},', '[{"id":"a', '[{"id":1}] x', '[{"id":1}]}', '[{"id":1}][', '{"id":1}', '[{"id":1},]', '[,{"id":1}]', '[{"id":1},,{"id":2}]', '[{"id":1]', "", "]", '[{"id":1} {"id":2}]', '[{"id":1}],{"id":2}', 'x[{"id":1}]'])
def test_what_is_no_array(spark, tmp_path, text, ranges, request):
    if ranges:
        request.getfixturevalue("small_ranges")
    path = tmp_path / "bad.json"
    filler = ", ".join('{"id": %d, "name": "long enough to be cut"}' % i for i in range(9)) if ranges else ""
    path.write_text(text.replace('{"id":1}', filler + ', {"id":1}') if filler else text)
    with pytest.raises((BadArray, PySparkException, Py4JJavaError)):
        read_json_array(spark, str(path), SCHEMA).collect()
