"""Shapes matched in streams of groups: equal to joins and folds, from one shuffle, whatever the size of a group."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from visgauge.functions import masks
from visgauge.operators import matching, protocol

KEYS = ["image", "category"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def shapes(spark, seed: int, kind: str, images: int = 15):
    rnd = random.Random(seed)
    make = {"box": lambda: [float(rnd.randrange(9)), float(rnd.randrange(9)), float(rnd.randrange(8, 30)), float(rnd.randrange(8, 30))], "mask": lambda: sorted(rnd.sample(range(40), rnd.choice([2, 4, 5, 6])))}[kind]
    sides: list[list] = [[], []]
    for image in [None, *range(images)]:
        for category in ("a", None, "b"):
            for side in sides:
                many = 60 if image == 3 else rnd.randrange(6)
                side += [(image, category, k, None if rnd.random() < 0.05 else make(), rnd.choice([None, 0.1, 0.5, 0.5, 0.9]), rnd.random() < 0.1) for k in range(many)]
    inner = {"box": "double", "mask": "long"}[kind]
    truth, found = (spark.createDataFrame(s, f"image long, category string, idx long, shape array<{inner}>, score double, crowd boolean") for s in sides)
    return truth, found.drop("crowd")


@pytest.mark.parametrize(("kind", "overlap"), [("box", protocol.box_overlap), ("mask", masks.mask_overlap)])
def test_streams_equal_joins_and_folds(spark, monkeypatch, kind, overlap):
    monkeypatch.setattr(matching, "BLOCK_ROWS", 7)  # of this process; workers that are forked later have it too
    truth, found = shapes(spark, 1, kind)
    want = protocol.hits(protocol.overlaps(truth, found, KEYS, overlap, 0.3), KEYS)
    got = protocol.taken(truth, found, KEYS, overlap, 0.3)
    assert {tuple(r)[:5] for r in got.collect()} == {tuple(r)[:5] for r in want.collect()}
    assert sorted(r.iou for r in got.collect()) == pytest.approx(sorted(r.iou for r in want.collect()))
    each = protocol.match_shapes(truth, found, KEYS, overlap, 0.3)
    total = each.agg(F.sum("gt"), F.sum("predicted"), F.sum("tp")).first()
    assert tuple(total) == (truth.count(), found.count(), want.count())


def test_blocks_and_pairs_are_bounded_and_whole(spark, monkeypatch):
    """Small blocks and few pairs at once give what one block gives."""
    truth, found = shapes(spark, 2, "mask")
    rows = matching.together(truth, found, KEYS, matching.MASK, F.asc_nulls_first(-F.col("score")), []).coalesce(1)
    batches = rows.toArrow().to_batches(max_chunksize=5)
    out = []
    for block_rows, pairs in ((7, 3), (10**6, 10**6)):
        monkeypatch.setattr(matching, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(matching, "PAIRS", pairs)
        each = list(matching.blocks(iter(batches), KEYS, matching.MASK))
        out.append([(r["image"], r["category"], r["idx"]) for b in each for r in b.table.take(b.hits(0.3)[0]).select([*KEYS, "idx"]).to_pylist()])
        assert sum(b.table.num_rows for b in each) == truth.count() + found.count()
    assert len(each) == 1 and sorted(out[0], key=str) == sorted(out[1], key=str)


def test_masks_are_matched_without_a_join(spark):
    truth, found = shapes(spark, 3, "mask", 2)
    assert "Join" not in plan(protocol.match_shapes(truth, found, KEYS, masks.mask_overlap, 0.5))


def test_unknown_overlaps_are_named(spark):
    truth, found = shapes(spark, 3, "box", 1)
    with pytest.raises(ValueError, match="Shape"):
        protocol.match_shapes(truth, found, KEYS, lambda f, t, c: F.lit(1.0))
