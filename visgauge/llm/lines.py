"""Line dedup by site-relative frequency: the share of a host's pages that contain a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import broadcast_up_to, checkpoint


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """host, line, n_pages, host_pages of the lines on more than ratio of their host's pages, and on min_pages or more.

    A page counts once for a line that it repeats. Lines are compared without blanks around them; empty lines are never
    boilerplate. Pages with a null host form a host of their own, and pages with a null text count for their host.
    Hashes of lines are counted first, with sums on the map side, so that a host's or a line's size does not matter;
    only lines whose hash is frequent are then counted as they are.
    """
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.btrim(x)))).alias("line")).where("line <> ''")
    lines = lines.withColumn("h", F.xxhash64("line"))

    def frequent(counts: DataFrame) -> DataFrame:
        t = totals.withColumnRenamed("host", "of")
        return counts.join(t, F.col("host").eqNullSafe(F.col("of"))).where((F.col("n_pages") >= min_pages) & (F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))).drop("of")

    hashes = checkpoint(frequent(lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_pages"))).select(F.col("host").alias("of"), F.col("h").alias("g")))
    hot = lines.join(broadcast_up_to(hashes, F.lit(64)), (F.col("h") == F.col("g")) & F.col("host").eqNullSafe(F.col("of")), "left_semi")
    return frequent(hot.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """docs with text_col less its host's boilerplate lines, and n_lines and n_dropped.

    Every row stays, also one of which no line is left (its text is empty then) and one with a null text (unchanged,
    0 lines). Other columns pass through, but those that have the names of the counts. The lines to drop travel as one array a host, of 1 / ratio times the lines of
    a mean page at most; they are broadcast up to a checked size and joined on the host beyond it.
    """
    lines = boilerplate_lines(docs, host_col, text_col, ratio, min_pages)
    drops = checkpoint(lines.groupBy("host").agg(F.collect_list("line").alias("drop")))
    size = F.aggregate("drop", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)) + 64
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(host_col).cast("string").alias("of"), _lines(F.col(text_col).cast("string")).alias("lines"))
    both = rows.join(broadcast_up_to(drops, size), F.col("of").eqNullSafe(F.col("host")), "left")
    stays = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), F.btrim(x))))
    both = both.withColumn("kept", stays)
    n_lines, n_kept = (F.greatest(F.size(c), F.lit(0)) for c in ("lines", "kept"))
    text = F.when(n_lines == n_kept, F.col("doc")[text_col]).otherwise(F.array_join("kept", "\n"))
    same = [text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return both.select(*same, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))
