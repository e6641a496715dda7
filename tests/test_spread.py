"""Rows of an image meet in partitions whose number follows from the rows, not from the session."""

from __future__ import annotations

import re

import pytest

from visgauge.operators.spread import partitions
from visgauge.plans import boxes, extras, protocol
from visgauge.plans.queries import QUERIES

CASES = [
    (protocol, "listing_sweep"),
    (boxes, "box_iou_pairs"),
    (extras, "coco_results"),
    (extras, "image_candidates"),
    (extras, "safe_relations"),
]


def test_partitions(spark):
    least = spark.sparkContext.defaultParallelism
    assert partitions(spark.range(0)) == least
    assert partitions(spark.range(10 * least), 1) == 10 * least
    assert partitions(spark.range(10 * least + 1), 10) == least + 1


@pytest.mark.parametrize(("module", "name"), CASES)
def test_rows_are_dealt_by_their_number(spark, monkeypatch, capsys, module, name):
    monkeypatch.setattr(module, "partitions", lambda df: 37, raising=False)
    QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    dealt = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\), ", capsys.readouterr().out)
    images = [(keys, n) for keys, n in dealt if re.search(r"image|orderkey|partkey|name", keys)]
    assert images and {n for _, n in images} == {"37"}
