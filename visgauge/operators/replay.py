"""Set-valued answers replayed under every candidate of a threshold grid from one pass over the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.functions.stats import ratio
from visgauge.operators.spread import partitions

#: What is summed up over images: the parts of a listing's score, and whether it is answered at all.
PARTS = ("precision", "recall", "f1", "exact", "answered", "answered_exact")


def _thresholds(values: list[float | None]) -> list[float | None]:
    """Each value once, in order; None (no bound, so that a null value passes too) is the lowest."""
    return sorted(set(values), key=lambda v: (v is not None, v or 0.0))


def _level(value: Column, steps: list[float | None]) -> Column:
    """The place, from 0, of the highest of the thresholds that a value reaches, -1 for none."""
    reached = [F.lit(1) if s is None else F.when(value >= s, 1).otherwise(0) for s in steps]
    return sum(reached[1:], reached[0]) - 1


def sweep_listings(evidence: DataFrame, targets: DataFrame, image: str, category: str, wanted: str, axes: dict[str, list[float | None]], parts: int | None = None) -> DataFrame:
    """Scores of listing answers for all candidates of the grid of axes: the columns of axes, images, answered, coverage,
    precision, recall, f1, exact (means over all images), selective_f1 and selective_exact (means over the answered).

    evidence: image, category, and a column for each axis, the thresholds of which a piece must reach on all axes to
    count; a null reaches no number, but passes the threshold None. The answer of an image is the set of categories with
    such a piece; it is withheld (selective) if it is empty. targets: image (once each) and the array wanted. Evidence of
    other images counts nowhere. An empty answer has the scores 0, and is exact if nothing is wanted.

    The first axis is swept, not tried: with all other thresholds fixed, a category enters an image's answer at its best
    value and stays. So an image's scores change at its entries alone; the changes are summed up by threshold, and the
    running sums from the highest threshold down are the totals of every candidate. What is shuffled grows with the
    evidence, not with images times candidates: an image's evidence and target meet once, in one of so many parts (None: by
    the rows of evidence), and its entries (times the cells of the other axes that they reach) stay there.
    """
    steps = {a: _thresholds(v) for a, v in axes.items()}
    swept, *others = steps
    for a in (*axes, "precision", "recall", "f1"):
        if a in (image, category):
            raise ValueError(f"{a} can't name an axis and a key")
    rows = evidence.select(F.col(image).alias("_image"), F.col(category).alias("_category"), *[_level(F.col(a), s).alias(f"_{k}") for k, (a, s) in enumerate(steps.items())])
    parts = parts or partitions(evidence)
    rows = rows.where(" and ".join(f"_{k} >= 0" for k in range(len(steps)))).repartition(parts, "_image")
    rows = rows.groupBy("_image", "_category", *[f"_{k}" for k in range(1, len(steps))]).agg(F.max("_0").alias("_0"))
    for k in range(1, len(steps)):  # a piece counts in its own cell and in those of all lower thresholds
        rows = rows.withColumn(f"_{k}", F.explode(F.sequence(F.lit(0), F.col(f"_{k}"))))
    cell = [f"_{k}" for k in range(1, len(steps))]
    entries = rows.groupBy("_image", "_category", *cell).agg(F.max("_0").alias("_0"))
    goal = targets.select(F.col(image).alias("_image"), F.array_distinct(F.coalesce(wanted, F.array().cast("array<string>"))).alias("_wanted"))
    marked = entries.join(goal.repartition(parts, "_image"), "_image").withColumn("_hit", F.array_contains("_wanted", F.col("_category")).cast("int"))
    at = marked.groupBy("_image", *cell, "_0").agg(F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_hits"), F.first(F.size("_wanted")).alias("_m"))
    down = W.partitionBy("_image", *cell).orderBy(F.desc("_0"))
    n, hits, m = (F.sum("_n").over(down), F.sum("_hits").over(down), F.col("_m"))
    state = at.select("_image", *cell, "_0", n.alias("_n"), hits.alias("_h"), m.alias("_m"))
    exact = ((F.col("_h") == F.col("_n")) & (F.col("_h") == F.col("_m"))).cast("double")
    scores = {"precision": F.col("_h") / F.col("_n"), "recall": ratio(F.col("_h"), F.col("_m"), None), "f1": 2.0 * F.col("_h") / (F.col("_n") + F.col("_m")), "exact": exact, "answered": F.lit(1.0), "answered_exact": exact}
    before = {p: F.lag(c, 1).over(down) for p, c in scores.items()}
    without = {"exact": (F.col("_m") == 0).cast("double")}  # of the empty answer
    changes = state.select(*cell, "_0", *[(c - F.coalesce(before[p], without.get(p, F.lit(0.0)))).alias(p) for p, c in scores.items()])
    summed = changes.groupBy(*cell, "_0").agg(*[F.sum(p).alias(p) for p in PARTS])

    spark = evidence.sparkSession
    grid = [()]
    for found in steps.values():
        grid = [(*g, k) for g in grid for k in range(len(found))]
    levels = spark.createDataFrame(grid, ", ".join(f"_{k} int" for k in range(len(steps))))
    total = goal.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.size("_wanted") == 0).alias("_empty"))
    lower = W.partitionBy(*cell).orderBy(F.desc("_0")) if cell else W.orderBy(F.desc("_0"))
    sums = levels.join(F.broadcast(summed), [*cell, "_0"], "left").select(*[f"_{k}" for k in range(len(steps))], *[F.sum(F.coalesce(p, F.lit(0.0))).over(lower).alias(p) for p in PARTS])
    out = sums.crossJoin(F.broadcast(total)).withColumn("exact", F.col("exact") + F.col("_empty"))  # one row
    named = [F.element_at(F.array(*[F.lit(v).cast("double") for v in s]), F.col(f"_{k}") + 1).alias(a) for k, (a, s) in enumerate(steps.items())]
    means = [ratio(F.round(F.col(p), 9), F.col("images")).alias(p) for p in ("precision", "recall", "f1", "exact")]
    answered = F.round("answered").cast("long")
    return out.select(*named, "images", answered.alias("answered"), ratio(answered, F.col("images")).alias("coverage"), *means, ratio(F.round("f1", 9), answered).alias("selective_f1"), ratio(F.round("answered_exact", 9), answered).alias("selective_exact"))
