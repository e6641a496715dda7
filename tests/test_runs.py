from __future__ import annotations

import json
import shutil
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from visgauge.streaming.runs import RunConflict, Sums, claim, follow_sums


def test_two_starts_at_once(spark, tmp_path):
    folder = str(tmp_path / "run")
    configs = [{"model": f"m{k % 2}", "seed": 1, "host": k} for k in range(12)]

    def start(config):
        try:
            return claim(spark, folder, config, ["model", "seed"])
        except RunConflict as e:
            return str(e)

    with ThreadPoolExecutor(12) as pool:
        said = list(pool.map(start, configs))
    winner = json.loads((tmp_path / "run" / "run_config.json").read_text())
    assert said.count("started") == 1 and said[winner["host"]] == "started"
    for config, word in zip(configs, said, strict=True):
        assert (word in ("started", "resumed")) == (config["model"] == winner["model"])
        assert config["model"] == winner["model"] or f'model: "{winner["model"]}" -> "{config["model"]}"' in word
    assert [p.name for p in (tmp_path / "run").iterdir()] == ["run_config.json"]
    assert claim(spark, folder, {"model": winner["model"], "seed": 1}, ["model", "seed", "none"]) == "resumed"


def test_commits(spark, tmp_path):
    state = Sums(spark, str(tmp_path / "s"), ["g"], ["n", "x"])
    make = lambda *rows: spark.createDataFrame(rows, "g string, n long, x double")
    read = lambda df: sorted(map(tuple, df.collect()))
    assert state.commits() == []
    assert read(state.add(0, make(("a", 1, 0.5), ("b", 2, 1.0)))) == [("a", 1, 0.5), ("b", 2, 1.0)]
    once = read(state.add(1, make(("a", 1, 0.5), ("a", 1, 0.5), ("c", 1, 0.0))))
    assert once == [("a", 3, 1.5), ("b", 2, 1.0), ("c", 1, 0.0)]
    assert read(state.add(1, make(("a", 1, 0.5), ("a", 1, 0.5), ("c", 1, 0.0)))) == once  # the batch again
    (tmp_path / "s" / "commit=1" / "_SUCCESS").unlink()  # it didn't end
    assert state.commits() == [0]
    assert read(state.add(1, make(("c", 4, 0.0)))) == [("a", 1, 0.5), ("b", 2, 1.0), ("c", 4, 0.0)]
    state.add(2, make())
    state.add(3, make())
    assert state.commits() == [2, 3] and read(state.at(3)) == [("a", 1, 0.5), ("b", 2, 1.0), ("c", 4, 0.0)]


def test_sums_follow_the_answers(spark, tmp_path):
    source, out, checkpoint, metrics = (str(tmp_path / n) for n in ("in", "out", "check", "metrics.json"))
    finish = lambda sums: sums.withColumn("accuracy", F.round(F.col("right") / F.col("n"), 6))
    parts = {"n": F.lit(1), "right": (F.col("answer") == "yes").cast("int")}
    schema = "id string, task string, answer string"

    def arrive(k: int, rows: list) -> dict:
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("id", "task", "answer"), r, strict=True))) for r in rows))
        follow_sums(spark, source, schema, out, checkpoint, "id", ["task"], parts, finish, metrics, valid="answer is not null").awaitTermination()
        return {r.task: (r.n, r.right, r.accuracy) for r in spark.read.json(metrics).collect()}

    assert arrive(0, [("1", "t", "yes"), ("2", "t", "no"), ("3", "u", None)]) == {"t": (2, 1, 0.5)}
    assert arrive(1, [("1", "t", "yes"), ("4", "t", "yes"), ("5", "u", "no")]) == {"t": (3, 2, 0.666667), "u": (1, 0, 0.0)}
    shutil.rmtree(f"{out}/batch=0")  # the answers before aren't read again
    assert arrive(2, [("6", "u", "yes")]) == {"t": (3, 2, 0.666667), "u": (2, 1, 0.5)}
    assert spark.read.json(f"{out}_errors").count() == 1

