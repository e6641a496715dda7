"""Greedy choices that depend on what was chosen before: splits balanced over many labels, and diverse selections.

Each pick is one aggregation over all candidates, as a score depends on the counts of features among the picks so far.
Only these counts, whose number is that of the features, and the picks stay on the driver. Candidates with the same
features have the same score but for their place in a salted order, so that they form one class first: a pick takes the
first of its best class, and a job's rows are classes. The number of jobs is the number of picks: these operators are
for benchmark sets of some hundreds of picks, out of any number of candidates.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.functions.boxes import size_name
from visgauge.functions.hashing import salted_order


def _weights(names: Column, weights: dict[str, float]) -> Column:
    """The sum of the weights of some names."""
    if not weights:
        return F.lit(0.0)
    found = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))])
    return F.aggregate(names, F.lit(0.0), lambda total, name: total + F.coalesce(F.try_element_at(found, name), F.lit(0.0)))


def _classes(df: DataFrame, by: list[str], order: Column, key: str, most: int) -> DataFrame:
    """by, n and members: the first `most` keys of each class in the salted order, as more are never picked of one."""
    ordered = F.slice(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(key).alias("k")))), 1, most)
    # a class of any size is cut into 256 parts by its order before it meets, each with its first rows only
    parts = df.groupBy(*by, F.substring(order, 1, 2).alias("_part")).agg(ordered.alias("_first"), F.count(F.lit(1)).alias("_n"))
    return parts.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("_first"))), 1, most).alias("members"), F.sum("_n").alias("n"))


def multilabel_split(
    df: DataFrame, key: str, features: str, dev_size: int, salt: str, covered: str = "category:", protect_singletons: bool = True, one: str = "dev", other: str = "test"
) -> DataFrame:
    """df with split: dev_size rows in `one`, chosen so that each feature has its share of them.

    features: an array of names. Of the rows left, each pick takes the one that holds the fewest singletons (features of
    the prefix `covered` that no other row has; as far as they are protected), then the most weight of features of that
    prefix that no pick has yet (1 over their number of rows, if two or more), then that brings the counts nearest to
    their targets by squared error over the number of rows, and last the first in a salted order of the keys. A target
    is the feature's share, at least 1 for those of the prefix with two rows or more, times the progress.
    """
    rows = df.select(F.col(key).alias("_key"), F.array_sort(F.array_distinct(features)).alias("_f"))
    total = {r["f"]: r["n"] for r in rows.select(F.explode("_f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = rows.count()
    if not 0 < dev_size < n:
        raise ValueError(f"dev_size lies between 1 and {n - 1}, not at {dev_size}")
    classes = _classes(rows, ["_f"], salted_order(F.col("_key"), salt), "_key", dev_size).cache()
    if not classes.where("size(_f) = 0").isEmpty():
        raise ValueError("a row has no feature")
    single = {f: 1.0 for f, c in total.items() if c == 1 and f.startswith(covered) and protect_singletons}
    open_ = {f: 1.0 / c for f, c in total.items() if c > 1 and f.startswith(covered)}
    target = {f: max(1.0, c * dev_size / n) if f in open_ else c * dev_size / n for f, c in total.items()}
    seen: Counter[str] = Counter()
    taken: Counter[tuple[str, ...]] = Counter()
    picks = []
    for slot in range(1, dev_size + 1):
        # of the squared errors, only what a row's own features change differs between rows: ((s + 1 - t)^2 - (s - t)^2) / c
        change = {f: (2 * (seen[f] - target[f] * slot / dev_size) + 1) / c for f, c in total.items()}
        used = F.lit(0)
        for own, times in taken.items():
            used = F.when(F.col("_f") == F.array(*map(F.lit, own)), times).otherwise(used)
        left = classes.withColumn("_used", used).where("_used < n").withColumn("_next", F.get("members", F.col("_used")))
        score = F.struct(F.round(_weights(F.col("_f"), single), 9).alias("a"), F.round(-_weights(F.col("_f"), open_), 9).alias("b"), F.round(_weights(F.col("_f"), change), 9).alias("c"), F.col("_next.o").alias("d"))
        best = left.agg(F.min_by(F.struct("_next.k", "_f"), score).alias("best")).first()["best"]
        own = tuple(best["_f"])
        picks.append(best["k"])
        taken[own] += 1
        seen.update(own)
        for f in own:
            open_.pop(f, None)
    classes.unpersist()
    chosen = df.sparkSession.createDataFrame([(p,) for p in picks], df.select(F.col(key).alias("_picked")).schema)
    return df.join(chosen, F.col(key) == F.col("_picked"), "left").withColumn("split", F.when(F.col("_picked").isNotNull(), one).otherwise(other)).drop("_picked")


def diverse_selection(df: DataFrame, key: str, group: str, score: str, tags: str, categories: str, quotas: dict[str, int], salt: str, category_weight: float = 0.2, most_categories: int = 10) -> DataFrame:
    """The rows of df that are chosen, with rank: for each group its quota of rows, each the best of those left.

    A row's worth is its score, plus 1 / (1 + picks with it) for each of its tags, plus category_weight times the same
    for its first most_categories categories; of equal ones the first in a salted order of the keys. All groups make
    their next pick in one job.
    """
    wanted = {g: q for g, q in quotas.items() if q > 0}
    rows = df.where(F.col(group).isin(list(wanted))).select(F.col(group).alias("_g"), F.col(key).alias("_key"), F.col(score).cast("double").alias("_s"), F.col(tags).alias("_t"), F.col(categories).alias("_c"))
    by = ["_g", "_s", "_t", "_c"]
    classes = _classes(rows, by, salted_order(F.col("_key"), salt), "_key", max(wanted.values(), default=1)).withColumn("_class", F.xxhash64(*by)).cache()
    sizes = {r["_g"]: r["n"] for r in classes.groupBy("_g").agg(F.sum("n").alias("n")).collect()}
    for g, q in wanted.items():
        if sizes.get(g, 0) < q:
            raise ValueError(f"{g} has {sizes.get(g, 0)} rows of the {q} that were asked for")
    seen: dict[str, tuple[Counter[str], Counter[str]]] = {g: (Counter(), Counter()) for g in wanted}
    taken: Counter[int] = Counter()
    picks: list[tuple] = []
    for rank in range(1, max(wanted.values(), default=0) + 1):
        now = [g for g, q in wanted.items() if rank <= q]
        # a feature without a pick is worth 1: its number counts, less what the picked ones have lost
        lost = F.lit(0.0)
        for g in now:
            t, c = ({k: 1 - 1 / (1 + n) for k, n in counts.items()} for counts in seen[g])
            lost = F.when(F.col("_g") == g, _weights(F.col("_t"), t) + category_weight * _weights(F.slice("_c", 1, most_categories), c)).otherwise(lost)
        worth = F.col("_s") + F.size("_t") + category_weight * F.least(F.size("_c"), F.lit(most_categories)) - lost
        used = _weights(F.array(F.col("_class").cast("string")), {str(k): n for k, n in taken.items()}).cast("int")
        left = classes.where(F.col("_g").isin(now)).withColumn("_used", used).where("_used < n").withColumn("_next", F.get("members", F.col("_used")))
        best = left.groupBy("_g").agg(F.min_by(F.struct("_next.k", "_class", "_t", "_c"), F.struct(F.round(-worth, 9).alias("a"), F.col("_next.o").alias("b"))).alias("best"))
        for r in best.collect():
            b = r["best"]
            picks.append((b["k"], rank))
            taken[b["_class"]] += 1
            seen[r["_g"]][0].update(b["_t"])
            seen[r["_g"]][1].update(b["_c"])
    classes.unpersist()
    schema = df.select(F.col(key).alias("_picked")).schema.add("rank", "integer")
    return df.join(df.sparkSession.createDataFrame(picks, schema), F.col(key) == F.col("_picked")).drop("_picked")


def image_features(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """image_id and the array features, `category:id` and `size:name`, of every image, as a split needs them.

    images: id; annotations: image_id, category_id, area (null: 0); categories: id. An annotation of an image or a
    category that isn't there, and an image without annotations, are errors, as is a table without images."""
    ids, known = images.select(F.col("id").alias("image_id")).distinct(), categories.select(F.col("id").alias("category_id")).distinct()
    for kind, lost in (("image", annotations.join(ids, "image_id", "left_anti").select("image_id")), ("category", annotations.join(F.broadcast(known), "category_id", "left_anti").select("category_id"))):
        first = lost.first()
        if first is not None:
            raise ValueError(f"an annotation is of the unknown {kind} {first[0]}")
    named = F.array(F.concat(F.lit("category:"), F.col("category_id")), F.concat(F.lit("size:"), size_name(F.coalesce(F.col("area").cast("double"), F.lit(0.0)))))
    found = annotations.select("image_id", F.explode(named).alias("f")).groupBy("image_id").agg(F.array_sort(F.collect_set("f")).alias("features"))
    out = ids.join(found, "image_id", "left")
    empty = [r[0] for r in out.where("features is null").orderBy("image_id").select("image_id").limit(10).collect()]
    if empty:
        raise ValueError(f"images without annotations: {empty}")
    if out.isEmpty():
        raise ValueError("there are no images")
    return out


def split_by_source(df: DataFrame, key: str, source: str, tags: str, categories: str, dev_share: float, salt: str) -> DataFrame:
    """df with split: for each source, a share of its rows (rounded, at least one on either side) in dev, balanced over
    difficulty tags and categories, singletons not protected. Sources are few; one with fewer than two rows is an error."""
    if not 0 < dev_share < 1:
        raise ValueError("dev_share lies between 0 and 1")
    prefixed = lambda c, p: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(p), x))
    rows = df.withColumn("_features", F.concat(prefixed(F.col(tags), "tag:"), prefixed(F.col(categories), "category:")))
    out = None
    for r in rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).orderBy(source).collect():
        if r["n"] < 2:
            raise ValueError(f"source {r[source]} has fewer than two rows")
        size = min(r["n"] - 1, max(1, round(r["n"] * dev_share)))
        part = multilabel_split(rows.where(F.col(source).eqNullSafe(r[source])), key, "_features", size, f"{salt}:{r[source]}", protect_singletons=False)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    return out.drop("_features")
