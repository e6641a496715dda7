"""Queries on rankings, duplicates, policies, datasets and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.functions import hashing
from visgauge.operators import datasets, dedup, policy, ranking
from visgauge.plans.registry import Tables, query
from visgauge.streaming import runs

_LINE_ORDER = "l_extendedprice DESC, l_quantity DESC, l_linenumber, l_partkey, l_suppkey"


def _line_order() -> list[Column]:
    return [F.desc("l_extendedprice"), F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]


@query(f"SELECT l_orderkey, l_partkey, l_extendedprice, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS rank FROM lineitem) WHERE rank <= 2")
def topk_candidates(t: Tables) -> DataFrame:
    return ranking.top_k(t.lineitem, ["l_orderkey"], _line_order(), 2).select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, l_quantity, -l_linenumber, -l_partkey)) AS strongest FROM lineitem GROUP BY 1")
def argmax_evidence(t: Tables) -> DataFrame:
    by = [F.col("l_extendedprice"), F.col("l_quantity"), -F.col("l_linenumber"), -F.col("l_partkey")]
    return ranking.strongest(t.lineitem, ["l_orderkey"], F.col("l_partkey"), by)


@query("""
    WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS depth, count(*) OVER (PARTITION BY user_id) AS group_rows FROM events WHERE event_type = 'error')
    SELECT user_id, event_id, depth::INTEGER AS depth, group_rows FROM e ORDER BY depth, group_rows DESC, user_id LIMIT 200""")
def representatives(t: Tables) -> DataFrame:
    errors = t.events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    return ranking.round_robin(errors, "user_id", [F.col("ts"), F.col("event_id")], 200).select("user_id", "event_id", "depth", "group_rows")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def last_answers(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return ranking.last_wins(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_samples(t: Tables) -> DataFrame:
    return runs.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query("""SELECT count(*) AS expected, count(l.doc_id) AS answered, CASE WHEN count(*) = count(l.doc_id) THEN 'completed' ELSE 'incomplete' END AS status
    FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def run_status(t: Tables) -> DataFrame:
    return runs.run_status(t.documents, t.labels, "doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('salt-1' || chr(0) || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def stable_order_sample(t: Tables) -> DataFrame:
    return ranking.stable_sample(t.documents.select("source", "doc_id"), "doc_id", "salt-1", 5, ["source"])


@query("""
    SELECT sha256(user_id || chr(10) || event_type)[1:24] AS key, min(event_id) AS first, count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ';') AS sources, count(DISTINCT event_type) <= 1 AS consistent
    FROM events GROUP BY 1""")
def query_groups(t: Tables) -> DataFrame:
    found = dedup.query_groups(t.events, hashing.key(F.col("user_id"), F.col("event_type")), F.col("event_id"), "event_type", "event_type")
    return found.withColumn("sources", F.array_join("sources", ";"))


@query("""
    WITH k AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS total, arg_min(value, event_id) AS one FROM events GROUP BY 1, 2)
    SELECT sum(n)::BIGINT AS n, count(*) AS keys, round(sum(total), 6) AS uncached, round(sum(one), 6) AS cached FROM k""")
def cached_latency(t: Tables) -> DataFrame:
    return dedup.cached_cost(t.events, hashing.key(F.col("user_id"), F.col("event_type")), F.col("event_id"), F.col("value"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS kept, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t: Tables) -> DataFrame:
    return dedup.exact_groups(t.documents, F.sha2("text", 256), "doc_id")


_SIGNED = """
    WITH b AS (SELECT o_custkey AS id, substr(md5('c' || o_custkey), 1, 15) AS h FROM (SELECT DISTINCT o_custkey FROM orders)),
    s AS (SELECT id, ('0x' || h)::BIGINT AS s FROM b UNION ALL SELECT id + 1000000000, xor(('0x' || h)::BIGINT, 1 + id % 16) FROM b)"""


def _signatures(t: Tables) -> DataFrame:
    """A signature of 60 bits for each customer that orders, and a copy of it with one to four bits changed."""
    base = t.orders.select(F.col("o_custkey").alias("id")).distinct()
    base = base.withColumn("s", F.conv(F.substring(F.md5(F.concat(F.lit("c"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long"))
    copy = base.select((F.col("id") + 1000000000).alias("id"), F.col("s").bitwiseXOR(1 + F.col("id") % 16).alias("s"))
    return base.unionByName(copy)


@query(f"{_SIGNED} SELECT a.id AS left, b.id AS right, bit_count(xor(a.s, b.s))::INTEGER AS distance FROM s a JOIN s b ON a.id < b.id AND bit_count(xor(a.s, b.s)) <= 4")
def near_duplicates(t: Tables) -> DataFrame:
    return dedup.near_pairs(_signatures(t), "id", "s", 4)


@query(f"""{_SIGNED.replace("WITH b", "WITH d AS (SELECT doc_id, text, source, sha256(text) AS digest FROM documents), b")},
    p AS (SELECT a.id AS l, b.id - 1000000000 AS r FROM s a JOIN s b ON a.id < b.id AND bit_count(xor(a.s, b.s)) <= 1 AND b.id >= 1000000000),
    near AS (SELECT DISTINCT unnest([l, r]) AS doc_id FROM p), x AS (SELECT doc_id, digest, length(text) < 40 AS bad FROM d WHERE source <> 'src0'),
    known AS (SELECT DISTINCT digest FROM d WHERE source = 'src0'), f AS (SELECT digest, min(doc_id) AS first FROM x WHERE NOT bad GROUP BY 1)
    SELECT x.doc_id, CASE WHEN known.digest IS NOT NULL THEN 'exact_reference' WHEN bad THEN 'invalid' WHEN x.doc_id <> f.first THEN 'exact_copy' WHEN near.doc_id IS NOT NULL THEN 'near_duplicate' ELSE 'accepted' END AS status
    FROM x LEFT JOIN known USING (digest) LEFT JOIN f ON x.digest = f.digest LEFT JOIN near ON x.doc_id = near.doc_id""")
def duplicate_status(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))
    pairs = dedup.near_pairs(_signatures(t), "id", "s", 1).where("right >= 1000000000").withColumn("right", F.col("right") - 1000000000)
    return dedup.duplicate_status(docs.where("source <> 'src0'"), "doc_id", "digest", docs.where("source = 'src0'"), "digest", pairs, F.col("n") < 40)


_GRID = [5.0, 10.0, 20.0, 40.0], [0.0, 25.0, 50.0]
_SWEEP = """
    WITH g AS (SELECT (row_number() OVER (ORDER BY least, most) - 1)::INTEGER AS candidate, least, most FROM (SELECT unnest([5.0, 10.0, 20.0, 40.0]::DOUBLE[]) AS least), (SELECT unnest([0.0, 25.0, 50.0]::DOUBLE[]) AS most)),
    r AS (SELECT candidate, least, most, value >= least AND user_id >= most AS p, event_type IN ('purchase', 'signup') AS t FROM events, g),
    c AS (SELECT candidate, least, most, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (NOT p AND t) AS fn FROM r GROUP BY 1, 2, 3),
    m AS (SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
          round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c)"""


def _swept(t: Tables) -> DataFrame:
    candidates = policy.grid(t.spark, least=_GRID[0], most=_GRID[1])
    values = {"least": F.col("value"), "most": F.col("user_id")}
    return policy.sweep_thresholds(t.events, candidates, values, {"least": _GRID[0], "most": _GRID[1]}, F.col("event_type").isin("purchase", "signup"))


@query(f"{_SWEEP} SELECT * FROM m")
def threshold_sweep(t: Tables) -> DataFrame:
    return _swept(t)


@query(f'{_SWEEP} SELECT candidate, least, most, accuracy, f1 FROM m WHERE recall >= 0.3 ORDER BY accuracy DESC, f1 DESC, candidate LIMIT 1')
def constrained_choice(t: Tables) -> DataFrame:
    best = ranking.constrained_best(_swept(t), F.col("recall") >= 0.3, [F.desc("accuracy"), F.desc("f1"), F.col("candidate")])
    return best.select("candidate", "least", "most", "accuracy", "f1")


@query(f"""{_SWEEP}, b AS (SELECT accuracy AS a, f1 AS f FROM m WHERE candidate = 1),
    j AS (SELECT 'p' || candidate AS policy_id, m.accuracy, m.f1, m."precision", tp AS helped, fp // 4 AS harmed, CASE WHEN candidate = 1 THEN ['baseline'] ELSE
          list_filter([CASE WHEN m.accuracy <= a THEN 'accuracy_not_improved' END, CASE WHEN m.f1 < f THEN 'f1_decreased' END, CASE WHEN tp <= fp // 4 THEN 'net_not_positive' END], lambda v: v IS NOT NULL) END AS reasons FROM m, b),
    best AS (SELECT policy_id FROM j WHERE len(reasons) = 0 ORDER BY accuracy DESC, f1 DESC, "precision" DESC, harmed, policy_id LIMIT 1)
    SELECT policy_id, accuracy, f1, "precision", helped, harmed, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS eligible, policy_id = coalesce((SELECT policy_id FROM best), 'p1') AS chosen FROM j""")
def policy_selection(t: Tables) -> DataFrame:
    swept = _swept(t).select(F.concat(F.lit("p"), F.col("candidate").cast("string")).alias("policy_id"), "accuracy", "f1", "precision", F.col("tp").alias("helped"), F.expr("fp div 4").alias("harmed"))
    return policy.judge(swept, F.col("policy_id") == "p1").withColumn("reasons", F.array_join("reasons", ";"))


_VOTES = """
    WITH v AS (SELECT doc_id, CASE WHEN toxic = 0 AND doc_id % 5 > 0 THEN 'yes' WHEN doc_id % 5 > 1 THEN 'no' END AS one, CASE WHEN quality = 1 AND doc_id % 7 > 0 THEN 'yes' WHEN doc_id % 7 > 2 THEN 'no' END AS two FROM labels)"""


@query(f"""{_VOTES} SELECT doc_id, coalesce(two, one) AS forced, CASE WHEN one = two THEN one END AS selective,
    CASE WHEN one IS NULL AND two IS NULL THEN 'none' WHEN two IS NULL THEN 'first_only' WHEN one IS NULL THEN 'second_only' WHEN one = two THEN 'agree' ELSE 'disagree' END AS status FROM v""")
def consensus(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    one = F.when((F.col("toxic") == 0) & (k % 5 > 0), "yes").when(k % 5 > 1, "no")
    two = F.when((F.col("quality") == 1) & (k % 7 > 0), "yes").when(k % 7 > 2, "no")
    return t.labels.select("doc_id", policy.consensus(one, two).alias("c")).select("doc_id", "c.*")


@query("SELECT quantile_disc(n, 0.2) AS threshold FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def tail_categories(t: Tables) -> DataFrame:
    return datasets.tail_threshold(t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")), "n")


_DIFFICULT = """
    WITH o AS (SELECT l_orderkey, min(l_quantity / 1000) AS min_area, bool_or(l_returnflag = 'R') AS occluded, bool_or(l_tax > 0.07) AS truncated, bool_or(l_discount > 0.095) AS group_of, count(*) AS n_objects,
               max(l_linenumber) AS top, count(DISTINCT l_returnflag || l_linestatus) AS n_categories, bool_or(l_partkey < 20) AS rare, count(*) FILTER (l_linestatus = 'F') AS n_relations FROM lineitem GROUP BY 1),
    k AS (SELECT l_orderkey, max(n) AS max_per_category FROM (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1),
    w AS (SELECT l_orderkey, list_filter([CASE WHEN min_area <= 0.005 THEN {'n': 'tiny_object', 'w': 2.0} END, CASE WHEN min_area > 0.005 AND min_area <= 0.02 THEN {'n': 'small_object', 'w': 1.0} END,
          CASE WHEN occluded THEN {'n': 'occluded', 'w': 1.5} END, CASE WHEN truncated THEN {'n': 'truncated', 'w': 1.0} END, CASE WHEN group_of THEN {'n': 'group_of', 'w': 1.0} END,
          CASE WHEN n_objects >= 8 THEN {'n': 'dense_instances', 'w': 1.5} END, CASE WHEN max_per_category >= 3 THEN {'n': 'repeated_category', 'w': 1.0} END, CASE WHEN n_categories >= 5 THEN {'n': 'category_diversity', 'w': 1.0} END,
          CASE WHEN rare THEN {'n': 'long_tail_category', 'w': 2.0} END, CASE WHEN n_relations >= 1 THEN {'n': 'spatial_relation', 'w': 1.5} END, CASE WHEN n_relations >= 5 THEN {'n': 'dense_relations', 'w': 1.0} END], lambda v: v IS NOT NULL) AS g
          FROM o JOIN k USING (l_orderkey))"""


def _difficulty(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("kind", F.concat("l_returnflag", "l_linestatus"))
    each = lines.groupBy("l_orderkey", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("l_quantity") / 1000).alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("o"), F.bool_or(F.col("l_tax") > 0.07).alias("u"), F.bool_or(F.col("l_discount") > 0.095).alias("g"),
        F.bool_or(F.col("l_partkey") < 20).alias("r"), F.count_if(F.col("l_linestatus") == "F").alias("f"),
    )
    orders = each.groupBy("l_orderkey").agg(
        F.min("a").alias("min_area"), F.bool_or("o").alias("occluded"), F.bool_or("u").alias("truncated"), F.bool_or("g").alias("group_of"), F.sum("n").alias("n_objects"), F.max("n").alias("max_per_category"),
        F.count(F.lit(1)).alias("n_categories"), F.bool_or("r").alias("rare"), F.sum("f").alias("n_relations"),
    )
    return datasets.difficulty(orders)


@query(f"{_DIFFICULT} SELECT l_orderkey, array_to_string(list_transform(g, lambda v: v.n), ';') AS tags, coalesce(list_sum(list_transform(g, lambda v: v.w)), 0)::DOUBLE AS score FROM w")
def difficulty_tags(t: Tables) -> DataFrame:
    return _difficulty(t).select("l_orderkey", F.array_join("tags", ";").alias("tags"), "score")


@query(f"""{_DIFFICULT}, s AS (SELECT l_orderkey, o_orderpriority, coalesce(list_sum(list_transform(g, lambda v: v.w)), 0)::DOUBLE AS score FROM w JOIN orders ON o_orderkey = l_orderkey)
    SELECT l_orderkey, o_orderpriority, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score DESC, sha256('hard' || chr(0) || l_orderkey), l_orderkey) AS rank FROM s) WHERE rank <= 40""")
def hard_selection(t: Tables) -> DataFrame:
    rows = _difficulty(t).select("l_orderkey", "score").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return datasets.quota_selection(rows, "l_orderkey", "o_orderpriority", F.col("score"), 40, "hard").select("l_orderkey", "o_orderpriority", "rank")


_SPLIT = """
    WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('split' || chr(0) || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM documents),
    s AS (SELECT doc_id, lang, source, CASE WHEN r <= CASE WHEN n = 1 THEN 0 ELSE greatest(1, least(n - 1, round(n * 0.2))) END THEN 'dev' ELSE 'test' END AS split FROM r)"""


def _split(t: Tables) -> DataFrame:
    return datasets.stratified_split(t.documents.select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 0.2, "split")


@query(f"{_SPLIT} SELECT doc_id, split FROM s")
def stratified_split(t: Tables) -> DataFrame:
    return _split(t).select("doc_id", "split")


@query(f"{_SPLIT} SELECT split, lang, count(*) AS n, count(DISTINCT source) AS sources FROM s GROUP BY 1, 2")
def split_statistics(t: Tables) -> DataFrame:
    return _split(t).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query(f"""{_SPLIT}, one AS (SELECT doc_id FROM s WHERE split = 'dev'), two AS (SELECT doc_id FROM s WHERE split = 'test' AND doc_id % 10 > 0), three AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 9 = 0),
    p AS (SELECT doc_id, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY 1)
    SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents)) AS whole, (SELECT count(*) FROM p) AS parts, (SELECT count(*) FROM p WHERE n > 1) AS overlap,
           (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)) AS missing, (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS "unknown\"""")
def split_algebra(t: Tables) -> DataFrame:
    """Two parts of the split, of which one lacks rows, and keys of another table, some of which the documents don't have."""
    parts = _split(t)
    other = t.orders.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return datasets.split_check(t.documents, [parts.where("split = 'dev'"), parts.where("split = 'test' and doc_id % 10 > 0"), other], "doc_id")


_NEGATIVES = """
    WITH pres AS (SELECT DISTINCT l_orderkey AS sample, p_name AS category FROM lineitem JOIN part ON l_partkey = p_partkey),
    v AS (SELECT DISTINCT p_name AS category, string_split(p_name, ' ')[-1] AS kind FROM part),
    o AS (SELECT p.sample, p.category, n.category AS negative FROM pres p JOIN v USING (category) JOIN v n ON v.kind = n.kind WHERE NOT EXISTS (SELECT 1 FROM pres q WHERE q.sample = p.sample AND q.category = n.category))
    SELECT sample, category, arg_min(negative, (sha256('neg:' || sample || ':' || category || ':' || negative), negative)) AS negative FROM o GROUP BY 1, 2"""


@query(_NEGATIVES)
def hard_negatives(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", F.col("p_name").alias("category"))
    here = t.lineitem.select(F.col("l_orderkey").alias("sample"), "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("sample", "category").distinct()
    vocabulary = parts.select("category", F.element_at(F.split("category", " "), -1).alias("kind")).distinct()
    return datasets.negatives(here, vocabulary, "sample", "category", "kind", "neg")


@query("""
    SELECT source, count(*) AS n, sum(('0x' || substr(sha256(doc_id || '|' || md5(text)), 1, 12))::BIGINT)::VARCHAR AS digest FROM documents GROUP BY 1""")
def frozen_digests(t: Tables) -> DataFrame:
    return datasets.frozen_digest(t.documents, F.concat_ws("|", F.col("doc_id").cast("string"), F.md5("text")), "source")


@query("""
    WITH n AS (SELECT o_orderkey, o_orderpriority, lower(trim(substr(o_orderpriority, 3))) AS what FROM orders)
    SELECT o_orderkey || ':existence' AS id, 'object_existence' AS task_type, 'Is there a ' || what || ' in the image?' AS question, CASE o_orderkey % 2 WHEN 0 THEN 'yes' ELSE 'no' END AS gt_answer FROM n
    UNION ALL SELECT o_orderkey || ':listing', 'object_listing', 'Which objects are in the image?', what FROM n""")
def question_templates(t: Tables) -> DataFrame:
    what = F.lower(F.trim(F.substr("o_orderpriority", F.lit(3))))
    n = t.orders.select("o_orderkey", what.alias("what"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("yes_no"))
    number = F.col("o_orderkey").cast("string")
    one = n.select(F.concat(number, F.lit(":existence")).alias("id"), F.lit("object_existence").alias("task_type"), F.concat(F.lit("Is there a "), "what", F.lit(" in the image?")).alias("question"), F.col("yes_no").alias("gt_answer"))
    two = n.select(F.concat(number, F.lit(":listing")).alias("id"), F.lit("object_listing").alias("task_type"), F.lit("Which objects are in the image?").alias("question"), F.col("what").alias("gt_answer"))
    return one.unionByName(two)
