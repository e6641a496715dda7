"""Negatives of even use: an assignment with capacities, in rounds."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visgauge.sources.folders import Steps


def _level(uses: dict[str, int], wanted: int) -> int:
    """The use up to which the least used names can be filled by `wanted` more."""
    order, left, k = sorted(uses.values()), wanted, 1
    level = order[0]
    while k < len(order) and (order[k] - level) * k <= left:
        left -= (order[k] - level) * k
        level = order[k]
        k += 1
    return level + left // k


def _accepted(asks: DataFrame, left: dict[str, int]) -> DataFrame:
    """Of the asks (image, positive, group, name), at most left[name] for each name, by a hash of the ask.

    Asks of a name are ranked in 256 parts of the hash, each on its own, after the counts of the parts before it."""
    spark = asks.sparkSession
    rows = asks.withColumn("_h", F.xxhash64("image", "positive", "name")).withColumn("_b", F.shiftrightunsigned("_h", 56))
    counts = rows.groupBy("name", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("name").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    room = spark.createDataFrame(list(left.items()), "name string, _left long")
    parts = before.join(F.broadcast(room), "name").where("_before < _left").drop("_n")
    ranked = rows.join(parts, ["name", "_b"]).withColumn("_r", F.row_number().over(W.partitionBy("name", "_b").orderBy("_h", "image", "positive")))
    return ranked.where("_before + _r <= _left").select("image", "positive", "group", "name")


def _no(waiting: DataFrame, served: DataFrame) -> DataFrame:
    """waiting with _no: what is present in the image, and what its requests have got."""
    taken = served.join(F.broadcast(waiting.select("image").distinct()), "image").groupBy("image").agg(F.collect_list("name").alias("_taken"))
    return waiting.drop("_no").join(taken, "image", "left").withColumn("_no", F.concat("present", F.coalesce("_taken", F.array().cast("array<string>")))).drop("_taken")


def _gained(rest: DataFrame, gained: DataFrame) -> DataFrame:
    """rest with the names in _no that others of the image have got now: gained (image, _gained)."""
    more = F.concat("_no", F.coalesce("_gained", F.array().cast("array<string>")))
    return rest.join(gained, "image", "left").withColumn("_no", more).drop("_gained")


def _dealt(waiting: DataFrame, free: dict[str, list[str]], left: dict[str, int]) -> list[tuple[str, str, str]]:
    """image, positive, name of the last few requests that wait, dealt on the driver: each in order gets the name of free
    with most room that it can have."""
    room, given, taken = dict(left), [], {}
    for r in waiting.select("image", "positive", "group", "_no").orderBy("image", "positive").collect():
        no = {*r["_no"], *taken.get(r.image, ())}
        able = [x for x in free[r["group"]] if room[x] and x not in no]
        if able:
            name = max(able, key=room.__getitem__)
            room[name] -= 1
            taken.setdefault(r.image, []).append(name)
            given.append((r.image, r.positive, name))
    return given


class _Served:
    """The requests that have a name (image, positive, group, present, name, _late), in stored parts: one a round, never
    written again. Names that swaps have changed since are kept beside them, until they are many."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.parts, self.changed, self.uses = spark, [], {}, Counter()

    def add(self, rows: DataFrame) -> None:
        self.parts.append(Steps(self.spark).stored(rows.select("image", "positive", "group", "present", "name", "_late")))
        self.uses.update({r["name"]: r["n"] for r in self.parts[-1].groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()})

    def change(self, names: dict[tuple[str, str], str], most: int = 10_000) -> None:
        self.changed |= names
        if len(self.changed) > most:
            self.parts, self.changed = [Steps(self.spark).stored(self.rows())], {}

    def rows(self) -> DataFrame:
        rows = reduce(DataFrame.unionByName, self.parts) if self.parts else self.spark.createDataFrame([], "image string, positive string, group string, present array<string>, name string, _late boolean")
        if not self.changed:
            return rows
        given = self.spark.createDataFrame([(*k, n) for k, n in self.changed.items()], "image string, positive string, _got string")
        return rows.join(F.broadcast(given), ["image", "positive"], "left").withColumn("name", F.coalesce("_got", "name")).drop("_got")


def _swaps(waiting: DataFrame, served: _Served, open_names: DataFrame, left: dict[str, int], most: int = 64, givers_at_once: int = 100_000) -> list:
    """Swaps that serve some of the requests that wait, each by a name that another one gives up for an open name of
    open_names (group, open). Up to `most` of a group's waiting requests find a giver each; of these swaps the driver
    takes those that touch different images and for which there is room.

    Givers are looked for in a part of the images, by hash, that holds about givers_at_once requests, and in all images
    if there is no swap in that part."""
    asking = waiting.withColumn("_r", F.row_number().over(W.partitionBy("group").orderBy("image", "positive"))).where(F.col("_r") <= most).select("group", "image", "positive", "_no")
    parts = max(1, served.uses.total() // givers_at_once)
    for k in sorted({parts, 1}, reverse=True):
        rows = served.rows().where(F.pmod(F.xxhash64("image", F.lit("part")), F.lit(k)) == 0)
        taken = rows.groupBy("image").agg(F.collect_list("name").alias("_taken"))
        givers = rows.where("not _late").join(taken, "image").withColumn("_no", F.concat("present", "_taken"))
        givers = givers.join(F.broadcast(open_names), "group").select("group", F.explode("open").alias("got"), "name", F.col("image").alias("g_image"), F.col("positive").alias("g_positive"), F.col("_no").alias("g_no"))
        fits = ~F.array_contains("g_no", F.col("got")) & ~F.array_contains("_no", F.col("name")) & (F.col("g_image") != F.col("image"))
        pairs = givers.join(F.broadcast(asking), "group").where(fits).withColumn("h", F.xxhash64("image", "positive", "g_image", "g_positive", "got"))
        found = pairs.groupBy("image", "positive").agg(F.min(F.struct("h", "g_image", "g_positive", "name", "got")).alias("s")).orderBy("image", "positive").collect()
        touched: set[str] = set()
        room, swaps = dict(left), []
        for r in found:
            if r.image not in touched and r.s.g_image not in touched and room[r.s.got]:
                touched |= {r.image, r.s.g_image}
                room[r.s.got] -= 1
                swaps.append(r)
        if swaps:
            return swaps
    return []


def _fill(waiting: DataFrame, served: _Served, names: dict[str, list[str]], probes: int = 8, few: int = 20_000) -> DataFrame:
    """The requests that are left of waiting (image, positive, group, present, _no) when those that can have a name of
    their group have gone to served. The names that others have already are never taken from those that are _late."""
    spark, steps, done = waiting.sparkSession, Steps(waiting.sparkSession), set()

    def counted() -> Counter:
        rows = waiting.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()
        return Counter({r["group"]: r["n"] for r in rows if names.get(r["group"]) and r["group"] not in done})

    used, wanted = served.uses, counted()
    limit: dict[str, int] = {}
    for g, n in wanted.items():
        level = _level({x: used[x] for x in names[g]}, n)
        limit |= {x: level for x in names[g]}
    round_ = 0
    while wanted:
        for g in wanted:  # filled alike as far as can be: now the rest, one more a name
            if all(used[x] >= limit[x] for x in names[g]):
                limit |= {x: limit[x] + 1 for x in names[g]}
        left = {x: limit[x] - used[x] for g in wanted for x in names[g] if used[x] < limit[x]}
        free = [(g, sorted(x for x in names[g] if x in left)) for g in wanted if any(x in left for x in names[g])]
        if free:
            open_names = spark.createDataFrame(free, "group string, open array<string>")
            before = wanted.total()
            if before <= few:
                given = _dealt(waiting.where(F.col("group").isin([g for g, _ in free])), dict(free), left)
                if given:
                    got = spark.createDataFrame(given, "image string, positive string, name string")
                    served.add(waiting.join(F.broadcast(got), ["image", "positive"]).withColumn("_late", F.lit(False)))
                    rest = waiting.join(F.broadcast(got), ["image", "positive"], "left_anti")
                    waiting = steps.stored(_gained(rest, F.broadcast(got.groupBy("image").agg(F.collect_list("name").alias("_gained")))))
            else:  # a few tries by hash in place of all names
                place = lambda k, n: (F.pmod(F.xxhash64("image", "positive", F.lit(round_), k), F.greatest(n, F.lit(1))) + 1).cast("int")  # noqa: B023, E731
                tries = F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda k: F.element_at("open", place(k, F.size("open"))))
                choice = F.try_element_at(F.filter(tries, lambda x: ~F.array_contains("_no", x)), F.lit(1))
                seen = waiting.join(F.broadcast(open_names), "group").withColumn("name", choice)
                asks = seen.where("name is not null").groupBy("image", "group", "name").agg(F.min("positive").alias("positive"))
                got = _accepted(asks, left).select("image", "positive", "name")
                asked = steps.stored(waiting.join(got, ["image", "positive"], "left"))
                new, rest = asked.where("name is not null"), asked.where("name is null").drop("name")
                served.add(new.withColumn("_late", F.lit(False)))
                gained = new.select("image", "name").join(rest.select("image").distinct(), "image").groupBy("image").agg(F.collect_list("name").alias("_gained"))
                waiting = steps.stored(_gained(rest, gained))
            wanted = counted()
            round_ += 1
            if wanted.total() < before:
                continue
            if before <= few and (swaps := _swaps(waiting.join(F.broadcast(open_names.select("group")), "group", "left_semi"), served, open_names, left)):
                given = spark.createDataFrame([(r.image, r.positive, r.s["name"]) for r in swaps], "image string, positive string, name string")
                served.change({(r.s.g_image, r.s.g_positive): r.s.got for r in swaps})
                served.add(waiting.join(F.broadcast(given), ["image", "positive"]).withColumn("_late", F.lit(False)))
                used.update(Counter(r.s.got for r in swaps))
                used.subtract(Counter(r.s["name"] for r in swaps))
                waiting = steps.stored(_no(waiting.join(F.broadcast(given), ["image", "positive"], "left_anti"), served.rows()))
                wanted = counted()
                continue
        whole = spark.createDataFrame([(g, names[g]) for g in wanted], "group string, open array<string>")
        able = waiting.join(F.broadcast(whole), "group").where(F.size(F.array_except("open", "_no")) > 0)
        served_groups = {r["group"] for r in able.select("group").distinct().collect()}
        done |= wanted.keys() - served_groups
        wanted = Counter({g: n for g, n in wanted.items() if g in served_groups})
        limit |= {x: limit[x] + 1 for g in served_groups for x in names[g]}  # nothing else helps
    return waiting


def balanced_negatives(requests: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """image, positive, name and selection (same_group or balanced_fallback) for each request.

    requests: image, positive (once an image), group and present, all strings, present an array. names: (group, name) of
    a vocabulary, held on the driver. A request gets a name of its group that isn't present in the image and that no
    other request of the image gets; if its group has none left, one of all names; it is left out if there is none.

    Names of a group are used evenly: first each up to the use that all can reach, then one more as long as requests
    are left. In a round each waiting request asks for one open name by hash, and each name accepts as many as it has room
    for; the others ask again, until they are so few that the driver deals them. Where the last requests can't have the last open names, they swap with one that can. Only
    if nothing else helps may a name be used more. What a round shuffles are the requests still waiting.
    """
    groups: dict[str, list[str]] = {}
    for g, n in names:
        groups.setdefault(g, []).append(n)
    texts = [F.col(c).cast("string").alias(c) for c in ("image", "positive", "group")]
    present = F.coalesce("present", F.array().cast("array<string>"))
    served = _Served(requests.sparkSession)
    start = Steps(requests.sparkSession).stored(requests.select(*texts, present.alias("present"), present.alias("_no")))
    rest = _fill(start, served, groups)
    same = served.rows().select("image", "positive", "name", F.lit("same_group").alias("selection"))
    if rest.isEmpty():
        return same
    served.parts = [rows.withColumn("_late", F.lit(True)) for rows in served.parts]
    _fill(rest.withColumn("group", F.lit("*")), served, {"*": [n for _, n in names]})
    selection = F.when(F.col("_late"), "same_group").otherwise("balanced_fallback")
    return served.rows().select("image", "positive", "name", selection.alias("selection"))
