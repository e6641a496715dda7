"""Queries on metrics, paired runs, failures and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.functions.text import official_answer, outcome
from visgauge.operators import failures, metrics, paired
from visgauge.operators.scoring import set_differences, set_scores
from visgauge.plans.answers import _ANSWERS, answers
from visgauge.plans.registry import Tables, query


def _ratio(a: str, b: str) -> str:
    return f"round(coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0), 6)"


_BINARY = f"""tp + fp + tn + fn AS n, tp, fp, tn, fn, {_ratio("tp + tn", "tp + fp + tn + fn")} AS accuracy, {_ratio("tp", "tp + fp")} AS "precision", {_ratio("tp", "tp + fn")} AS recall,
    {_ratio("2 * tp", "2 * tp + fp + fn")} AS f1, {_ratio("tp + fp", "tp + fp + tn + fn")} AS yes_ratio"""
_COUNTS = "count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (NOT p AND t) AS fn"


def labelled(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query(f"""
    WITH r AS (SELECT lang, source, quality = 1 AS t, toxic = 0 AS p FROM labels JOIN documents USING (doc_id)),
    g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS scope, coalesce(lang, source) AS value, {_COUNTS}
          FROM r GROUP BY GROUPING SETS ((), (lang), (source)))
    SELECT scope, value, {_BINARY} FROM g""")
def binary_metrics(t: Tables) -> DataFrame:
    return metrics.binary_metrics(labelled(t), F.col("toxic") == 0, F.col("quality") == 1, ["lang", "source"])


@query("""
    SELECT event_type, bucket, grouping(event_type, bucket)::BIGINT AS level, count(*) AS n, round(avg(value), 6) AS mean_score, round(avg((value > 50)::INT), 6) AS accuracy
    FROM (SELECT *, user_id % 10 AS bucket FROM events) GROUP BY GROUPING SETS ((), (event_type), (bucket), (event_type, bucket))""")
def task_metrics(t: Tables) -> DataFrame:
    rows = t.events.withColumn("bucket", F.col("user_id") % 10)
    return metrics.grouped_metrics(rows, F.col("value"), F.col("value") > 50, "event_type", "bucket")


@query("""
    SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median,
           round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95, round(count(value) / sum(value), 6) AS per_second FROM events GROUP BY 1""")
def latency_summary(t: Tables) -> DataFrame:
    return metrics.latency_summary(t.events, F.col("value"), "event_type")


_ORDERS = "SELECT o_orderpriority AS target, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice < 200000 THEN '1-URGENT' WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '5-LOW' END AS guess FROM orders"


def _guesses(t: Tables) -> DataFrame:
    guess = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_totalprice") < 200000, "1-URGENT").when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("5-LOW")
    return t.orders.select(F.col("o_orderpriority").alias("target"), guess.alias("guess"))


@query(f"SELECT target, coalesce(guess, 'invalid') AS prediction, count(*) AS n FROM ({_ORDERS}) GROUP BY 1, 2")
def confusion_matrix(t: Tables) -> DataFrame:
    return metrics.confusion(_guesses(t), "target", "guess")


@query(f"""
    WITH e AS (SELECT target, count(*) AS n, count(*) FILTER (target = guess) AS hits FROM ({_ORDERS}) GROUP BY 1)
    SELECT sum(n)::BIGINT AS n, {_ratio("sum(hits)", "sum(n)")} AS accuracy, round(avg(hits / n), 6) AS balanced_accuracy, {_ratio("max(n)", "sum(n)")} AS majority_baseline FROM e""")
def balanced_accuracy(t: Tables) -> DataFrame:
    return metrics.balanced_accuracy(_guesses(t), "target", "guess")


_SETS = """
    WITH s AS (SELECT l_orderkey, coalesce(list_sort(list_distinct(list(l_returnflag) FILTER (l_discount >= 0.03))), []) AS p, list_sort(list_distinct(list(l_returnflag) FILTER (l_linestatus = 'F'))) AS t0 FROM lineitem GROUP BY 1),
    x AS (SELECT l_orderkey, p, coalesce(t0, []) AS t FROM s),
    c AS (SELECT *, len(list_intersect(p, t)) AS tp, len(p) - len(list_intersect(p, t)) AS fp, len(t) - len(list_intersect(p, t)) AS fn FROM x)"""


def _sets(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_discount") >= 0.03, flag)).alias("p"), F.collect_set(F.when(F.col("l_linestatus") == "F", flag)).alias("t"))
    return sets.select("l_orderkey", set_scores(F.col("p"), F.col("t")).alias("s"), set_differences(F.col("p"), F.col("t")).alias("d"))


@query(f"""{_SETS} SELECT l_orderkey, {_ratio("tp", "len(p)")} AS "precision", {_ratio("tp", "len(t)")} AS recall, {_ratio("2 * tp", "len(p) + len(t)")} AS f1, tp = len(p) AND tp = len(t) AS exact_match FROM c""")
def set_score_rows(t: Tables) -> DataFrame:
    return _sets(t).select("l_orderkey", "s.*")


@query(f"""{_SETS} SELECT count(*) AS n, {_ratio("sum(tp)", "sum(tp) + sum(fp)")} AS micro_precision, {_ratio("sum(tp)", "sum(tp) + sum(fn)")} AS micro_recall, {_ratio("2 * sum(tp)", "2 * sum(tp) + sum(fp) + sum(fn)")} AS micro_f1,
    round(avg({_ratio("tp", "len(p)")}), 6) AS macro_precision, round(avg({_ratio("tp", "len(t)")}), 6) AS macro_recall, round(avg({_ratio("2 * tp", "len(p) + len(t)")}), 6) AS macro_f1,
    round(avg((tp = len(p) AND tp = len(t))::INT), 6) AS exact_match FROM c""")
def set_summary(t: Tables) -> DataFrame:
    return metrics.set_summary(_sets(t), "s", "d")


@query(f"{_SETS}, h AS (SELECT unnest(list_filter(p, lambda v: NOT list_contains(t, v))) AS name FROM c) SELECT name, count(*) AS n FROM h GROUP BY 1")
def hallucinated_frequency(t: Tables) -> DataFrame:
    return metrics.frequency(_sets(t), F.col("d.hallucinated"))


@query("""
    SELECT CASE WHEN value IS NULL THEN 0 WHEN value < 5 THEN 1 WHEN value < 10 THEN 2 WHEN value < 50 THEN 3 ELSE 4 END::INTEGER AS bin, count(*) AS n FROM events GROUP BY 1""")
def score_histogram(t: Tables) -> DataFrame:
    return metrics.histogram(t.events, F.col("value"), [5.0, 10.0, 50.0])


_OUTCOMES = f"""
    WITH a AS ({_ANSWERS}), o AS (SELECT *, CASE WHEN list_has_any(string_split(replace(string_split(answer, '.')[1], ',', ''), ' '), ['No', 'no', 'not']) THEN 'no' ELSE 'yes' END AS said FROM a),
    r AS (SELECT *, CASE WHEN target = 'yes' THEN CASE said WHEN 'yes' THEN 'TP' ELSE 'FN' END ELSE CASE said WHEN 'yes' THEN 'FP' ELSE 'TN' END END AS outcome FROM o)"""


def _outcomes(t: Tables) -> DataFrame:
    rows = answers(t).withColumn("said", official_answer(F.col("answer")))
    return rows.withColumn("outcome", outcome(F.col("said"), F.col("target")))


def _error_sql(group: str, key: str) -> str:
    return f"""{_OUTCOMES} SELECT {group}, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'FN') AS fn,
        count(DISTINCT {key}) FILTER (outcome IN ('FP', 'FN')) AS error_keys, {_ratio("count(*) FILTER (outcome = 'TP')", "count(*) FILTER (outcome IN ('TP', 'FN'))")} AS recall,
        {_ratio("count(*) FILTER (outcome = 'FP')", "count(*) FILTER (outcome IN ('FP', 'TN'))")} AS false_positive_rate, count(*) FILTER (outcome IN ('FP', 'FN')) AS errors FROM r GROUP BY 1"""


@query(_error_sql("source", "doc_id"))
def object_error_rows(t: Tables) -> DataFrame:
    return metrics.error_rows(_outcomes(t), "source", "outcome", "doc_id")


@query(_error_sql("lang", "source"))
def image_error_rows(t: Tables) -> DataFrame:
    return metrics.error_rows(_outcomes(t), "lang", "outcome", "source")


@query(f"""{_OUTCOMES}, k AS (SELECT source, count(DISTINCT lang) AS r, count(DISTINCT said) AS a FROM r GROUP BY 1)
    SELECT count(*) AS keys, count(*) FILTER (r = 4) AS complete, count(*) FILTER (a > 1) AS disagreeing FROM k""")
def repetition_consistency(t: Tables) -> DataFrame:
    return metrics.consistency(_outcomes(t), "source", "said", "lang", 4)


_PAIRED = """SELECT d.lang, d.source, (l.toxic = 0) = (l.quality = 1) AS a, (d.n_chars > 1000) = (l.quality = 1) AS b FROM labels l JOIN documents d USING (doc_id)"""


def _mcnemar(b: str, c: str) -> str:
    """The exact test through the logarithms of factorials."""
    term = f"exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2.0))"
    return f"CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum({term}) FROM unnest(generate_series(0, least({b}, {c}))) AS u(i))), 6) END"


def _paired_sql(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH r AS ({_PAIRED}), c AS (SELECT {by + "," if by else ""} count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (NOT a AND b) AS second_only,
        count(*) FILTER (NOT a AND NOT b) AS neither FROM r {group})
        SELECT *, "both" + first_only + second_only + neither AS n, second_only - first_only AS net, {_ratio('"both" + first_only', '"both" + first_only + second_only + neither')} AS first_accuracy,
        {_ratio('"both" + second_only', '"both" + first_only + second_only + neither')} AS second_accuracy, {_mcnemar("first_only", "second_only")} AS p_value FROM c"""


def _runs(t: Tables) -> tuple[DataFrame, Column, Column]:
    good = F.col("quality") == 1
    return labelled(t), (F.col("toxic") == 0) == good, (F.col("n_chars") > 1000) == good


@query(_paired_sql(""))
def paired_outcomes(t: Tables) -> DataFrame:
    return paired.paired_outcomes(*_runs(t))


@query(_paired_sql("lang"))
def paired_outcomes_by_lang(t: Tables) -> DataFrame:
    return paired.paired_outcomes(*_runs(t), by=["lang"])


@query(f"WITH r AS ({_PAIRED}) SELECT source, CASE WHEN a AND b THEN 'kept_correct' WHEN a THEN 'broken' WHEN b THEN 'fixed' ELSE 'kept_wrong' END AS transition, count(*) AS n FROM r GROUP BY 1, 2")
def transitions(t: Tables) -> DataFrame:
    rows, a, b = _runs(t)
    return rows.groupBy("source", paired.transition(a, b).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH r AS (SELECT lang, quality = 1 AS t, toxic = 0 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang = 'en' AS dev, {_COUNTS} FROM r GROUP BY 1),
    m AS (SELECT dev, {_BINARY} FROM c), u AS (UNPIVOT m ON accuracy, "precision", recall, f1 INTO NAME metric VALUE v)
    SELECT a.metric, a.v AS dev, b.v AS test, round(b.v - a.v, 6) AS delta FROM u a JOIN u b USING (metric) WHERE a.dev AND NOT b.dev""")
def generalization_rows(t: Tables) -> DataFrame:
    rows = labelled(t)
    dev, test = (metrics.binary_metrics(rows.where(c), F.col("toxic") == 0, F.col("quality") == 1) for c in (F.col("lang") == "en", F.col("lang") != "en"))
    return metrics.unpivot_metrics(dev, test, ["accuracy", "precision", "recall", "f1"], ("dev", "test"))


@query(f"""SELECT count(d.doc_id) AS expected, count(l.doc_id) AS observed, count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS common, count(*) FILTER (l.doc_id IS NULL) AS missing,
    count(*) FILTER (d.doc_id IS NULL) AS extra, {_ratio("count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL)", "count(d.doc_id)")} AS coverage
    FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def coverage_report(t: Tables) -> DataFrame:
    return paired.coverage(t.documents, t.labels, "doc_id")


@query("""
    SELECT 'price_positive' AS rule, count(*) FILTER (NOT coalesce(l_extendedprice > 0, false)) AS violations FROM lineitem
    UNION ALL SELECT 'tax_below_discount', count(*) FILTER (NOT coalesce(l_tax < l_discount, false)) FROM lineitem
    UNION ALL SELECT 'known_flag', count(*) FILTER (NOT coalesce(l_returnflag IN ('A', 'N', 'R'), false)) FROM lineitem""")
def integrity_checks(t: Tables) -> DataFrame:
    return paired.violations(t.lineitem, {"price_positive": F.col("l_extendedprice") > 0, "tax_below_discount": F.col("l_tax") < F.col("l_discount"), "known_flag": F.col("l_returnflag").isin("A", "N", "R")})


@query("SELECT key, count(*) AS n FROM (SELECT l_orderkey * 10 + l_linenumber AS key FROM lineitem) GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(t: Tables) -> DataFrame:
    return paired.repeated_keys(t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")), "key")


_FLAGGED = """
    WITH f AS (SELECT d.doc_id, d.source, l.quality = 0 AS low, l.toxic = 1 AS toxic, d.n_chars < 100 AS short, d.lang <> 'en' AS foreign_text FROM labels l JOIN documents d USING (doc_id)),
    s AS (SELECT doc_id, source, list_filter([CASE WHEN low THEN 'low_quality' END, CASE WHEN toxic THEN 'toxic' END, CASE WHEN short THEN 'short' END, CASE WHEN foreign_text THEN 'foreign' END], lambda v: v IS NOT NULL) AS flags,
          3.0 * low::INT + 4.0 * toxic::INT + 1.0 * short::INT + 0.5 * foreign_text::INT AS severity FROM f)"""


def _flagged(t: Tables) -> DataFrame:
    flags = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "short": F.col("n_chars") < 100, "foreign": F.col("lang") != "en"}
    return failures.flagged(labelled(t), flags, {"low_quality": 3, "toxic": 4, "short": 1, "foreign": 0.5})


@query(f"{_FLAGGED} SELECT doc_id, array_to_string(flags, ';') AS flags, severity::DOUBLE AS severity FROM s")
def failure_flags(t: Tables) -> DataFrame:
    return _flagged(t).select("doc_id", F.array_join("flags", ";").alias("flags"), "severity")


@query(f"{_FLAGGED} SELECT doc_id, severity::DOUBLE AS severity FROM s WHERE severity > 0 ORDER BY severity DESC, doc_id LIMIT 20")
def severity_topk(t: Tables) -> DataFrame:
    return failures.worst(_flagged(t), "doc_id", 20).select("doc_id", "severity")


@query(f"{_FLAGGED}, u AS (SELECT source, unnest(flags) AS flag FROM s) SELECT flag, source, count(*) AS n FROM u GROUP BY GROUPING SETS ((flag), (flag, source))")
def flag_counts(t: Tables) -> DataFrame:
    return failures.flag_counts(_flagged(t), "source")


@query(f"""
    WITH s AS (SELECT sum((quality = 0)::INT)::BIGINT AS low, sum(toxic)::BIGINT AS toxic, sum((n_chars < 100)::INT)::BIGINT AS short FROM labels JOIN documents USING (doc_id)),
    u AS (SELECT low + toxic + short AS total, unnest(['low', 'toxic', 'short']) AS stage, unnest([low, toxic, short]) AS n FROM s)
    SELECT stage, n, {_ratio("n", "total")} AS share FROM u""")
def stage_shares(t: Tables) -> DataFrame:
    rows = labelled(t).select((F.col("quality") == 0).cast("int").alias("low"), F.col("toxic"), (F.col("n_chars") < 100).cast("int").alias("short"))
    return failures.stage_shares(rows, ["low", "toxic", "short"])


@query("""
    SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'clean' WHEN quality = 1 THEN 'toxic_only' WHEN toxic = 1 THEN 'both' WHEN n_chars < 200 THEN 'short_junk' ELSE 'other' END AS kind, count(*) AS n
    FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def taxonomy(t: Tables) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    kind = failures.taxonomy([("clean", good & ~toxic), ("toxic_only", good), ("both", toxic), ("short_junk", F.col("n_chars") < 200)])
    return labelled(t).groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
