from __future__ import annotations

import hashlib
import json

import pytest

from visgauge.sources.folders import Folder
from visgauge.sources.release import BrokenRelease, freeze, read_manifest, read_release, verify

SCHEMA = "id long, name string, tags array<string>"


def rows(spark, n=40, parts=3, change=None):
    return spark.createDataFrame([(i, f"né {i}" if i != change else "x", ["a", str(i)] if i % 3 else None) for i in range(n)], SCHEMA).repartition(parts)


def frozen(spark, path, **kwargs):
    return freeze({"items": rows(spark, **kwargs), "plain": rows(spark, **kwargs)}, str(path), {"items": ["id"], "plain": ["name", "id"]}, {"seed": 3}, {"plain": "csv"}, files=4)


def test_same_files_from_other_partitions(spark, tmp_path):
    one, two = frozen(spark, tmp_path / "one"), frozen(spark, tmp_path / "two", parts=7)
    assert one == two == read_manifest(spark, str(tmp_path / "one")) and one["tables"]["items"]["rows"] == 40
    for f in one["files"]:
        data = (tmp_path / "one" / f["path"]).read_bytes()
        assert len(data) == f["bytes"] and hashlib.sha256(data).hexdigest() == f["sha256"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "two"]
    found = [json.loads(x) for f in one["files"] if f["path"].startswith("items/") for x in (tmp_path / "one" / f["path"]).read_text().splitlines()]
    assert sorted(r["id"] for r in found) == list(range(40)) and list(found[0]) == sorted(found[0])
    assert (tmp_path / "one" / "plain" / "part-00000.csv").read_text().splitlines()[0] == "id,name,tags"
    back = read_release(spark, str(tmp_path / "one"), "items", SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows(spark).collect()))
    assert read_release(spark, str(tmp_path / "one"), "plain", "id long, name string, tags string").count() == 40


def test_what_differs_is_named(spark, tmp_path):
    path = tmp_path / "r"
    files = [f["path"] for f in frozen(spark, path)["files"]]
    assert verify(spark, str(path)) == []
    first, second, third = (path / f for f in files[:3])
    first.write_bytes(first.read_bytes().replace(b"n", b"m", 1))
    second.write_bytes(second.read_bytes() + b"\n")
    third.unlink()
    (path / "items" / "more.jsonl").write_text("{}")
    for crc in path.rglob(".*.crc"):
        crc.unlink()
    assert verify(spark, str(path)) == sorted([f"{files[0]}: changed", f"{files[1]}: of another size", f"{files[2]}: missing", "items/more.jsonl: not in the manifest"])
    with pytest.raises(BrokenRelease, match=files[0]):
        read_release(spark, str(path), "items", SCHEMA)


def test_frozen_again(spark, tmp_path):
    first = frozen(spark, tmp_path / "r")
    assert frozen(spark, tmp_path / "r", parts=5) == first
    with pytest.raises(BrokenRelease, match="changed|another size"):
        frozen(spark, tmp_path / "r", change=7)
    assert verify(spark, str(tmp_path / "r")) == [] and len(list(tmp_path.iterdir())) == 1


def test_keys_that_name_no_row(spark, tmp_path):
    for bad in (rows(spark).unionByName(rows(spark).limit(1)), rows(spark).unionByName(spark.createDataFrame([(None, "x", None)], SCHEMA))):
        with pytest.raises(BrokenRelease, match="aren't named"):
            freeze({"items": bad}, str(tmp_path / "r"), {"items": ["id"]})
    assert list(tmp_path.iterdir()) == []
    empty = freeze({"items": rows(spark).limit(0)}, str(tmp_path / "e"), {"items": ["id"]})
    assert empty["tables"]["items"]["rows"] == 0 and verify(spark, str(tmp_path / "e")) == []
    with pytest.raises(BrokenRelease, match="no manifest"):
        verify(spark, str(tmp_path / "none"))


def test_one_of_two_creates(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    assert folder.create("a.json", b"1") and not folder.create("a.json", b"2") and folder.read("a.json") == b"1"
    folder.replace("a.json", b"33")
    assert folder.read("a.json") == b"33" and folder.files()["a.json"] == 2
