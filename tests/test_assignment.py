from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from visgauge.operators.assignment import _level, balanced_negatives

SCHEMA = "image string, positive string, group string, present array<string>"


def test_levels():
    assert _level({"a": 0, "b": 0, "c": 0}, 7) == 2 and _level({"a": 5, "b": 0}, 3) == 3 and _level({"a": 5, "b": 0}, 5) == 5 and _level({"a": 5, "b": 1}, 6) == 6 and _level({"a": 3}, 0) == 3


def made(seed: int, images: int, groups: int, size: int):
    rnd = random.Random(seed)
    names = [(f"g{g}", f"n{g}_{k}") for g in range(groups) for k in range(size)]
    of = {n: g for g, n in names}
    rows = []
    for i in range(images):
        present = rnd.sample([n for _, n in names], rnd.randrange(1, 6))
        rows += [(f"i{i}", p, of[p], present) for p in present]
    return names, rows


def check(rows, names, found):
    of, present = {n: g for g, n in names}, {(r[0], r[1]): r for r in rows}
    assert len(found) == len({(r.image, r.positive) for r in found}) == len({(r.image, r["name"]) for r in found})
    assert all(r["name"] not in (present[r.image, r.positive][3] or []) for r in found)
    assert all((of[r["name"]] == present[r.image, r.positive][2]) == (r.selection == "same_group") for r in found)
    uses = defaultdict(Counter)
    for r in found:
        uses[of[r["name"]]][r["name"]] += 1
    return uses


@pytest.mark.parametrize(("seed", "images"), [(1, 400), (2, 37)])
def test_even_use(spark, seed, images):
    names, rows = made(seed, images, 4, 8)
    found = balanced_negatives(spark.createDataFrame(rows, SCHEMA), names).collect()
    uses = check(rows, names, found)
    assert len(found) == len(rows)
    for g, wanted in Counter(r[2] for r in rows).items():
        own = [uses[g][n] for h, n in names if h == g]
        assert sum(own) == wanted and max(own) - min(own) <= 1


def test_no_name_of_the_group_left(spark):
    names = [("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "b2"), ("b", "b3")]
    rows = [("i1", "a1", "a", ["a1", "a2"]), ("i1", "a2", "a", ["a1", "a2"]), ("i2", "a1", "a", ["a1"]), ("i3", "x", "unknown", None), ("i4", "b1", "b", [n for _, n in names])]
    found = balanced_negatives(spark.createDataFrame(rows, SCHEMA), names).collect()
    check(rows, names, found)
    by = {(r.image, r.positive): (r["name"], r.selection) for r in found}
    assert by["i2", "a1"] == ("a2", "same_group") and {by["i1", "a1"][1], by["i1", "a2"][1], by["i3", "x"][1]} == {"balanced_fallback"}
    assert by["i1", "a1"][0] != by["i1", "a2"][0] and ("i4", "b1") not in by
    assert balanced_negatives(spark.createDataFrame([], SCHEMA), names).collect() == []


def test_same_result_again(spark):
    names, rows = made(5, 30, 2, 6)
    once, again = (sorted(map(tuple, balanced_negatives(spark.createDataFrame(rows, SCHEMA).repartition(n), names).collect())) for n in (1, 5))
    assert once == again


def test_served_requests_are_not_written_again(spark, monkeypatch):
    from visgauge.sources.folders import Steps

    written, stored = [], Steps.stored

    def counted(self, df):
        out = stored(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(Steps, "stored", counted)
    names = [("g", f"n{k}") for k in range(6)]
    rows = [(str(i), f"n{i % 6}", "g", [f"n{i % 6}", f"n{(i + 1) % 6}"]) for i in range(200)]
    found = balanced_negatives(spark.createDataFrame(rows, "image string, positive string, group string, present array<string>"), names).collect()
    assert len(found) == 200 and sum(written) <= 3 * 200
