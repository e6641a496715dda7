"""Queries on second opinions, joint scores, greedy selections and digests of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.operators import candidates, datasets, live, questions, review, selection
from visgauge.operators.spread import partitions
from visgauge.plans.boxes import _GREEDY, lines
from visgauge.plans.choices import _difficulty
from visgauge.plans.registry import Tables, query
from visgauge.streaming import runs


@query("SELECT source, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents GROUP BY 1")
def digest_ordered(t: Tables) -> DataFrame:
    return datasets.ids_digest(t.documents, "doc_id", "source", "\n", "\n")


@query("SELECT source, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest FROM (SELECT DISTINCT source, doc_id FROM documents) GROUP BY 1")
def digest_sorted(t: Tables) -> DataFrame:
    return datasets.ids_digest(t.documents.select("source", "doc_id").distinct(), "doc_id", "source", ",")


@query("""
    WITH d AS (SELECT doc_id AS id, string_split(lower(text), ' ') AS w FROM documents), i AS (SELECT item_id AS id, string_split(lower(text), ' ') AS w FROM benchmark),
    dg AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g FROM d), ig AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g FROM i)
    SELECT dg.id AS doc_id, ig.id AS item_id, count(*) AS shared FROM dg JOIN ig USING (g) GROUP BY 1, 2""")
def benchmark_overlap(t: Tables) -> DataFrame:
    """Documents and benchmark items that share runs of eight words, with the number of different ones."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, F.split(F.lower("text"), " ").alias("w")).where("size(w) >= 8")
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda k: F.array_join(F.slice("w", k, 8), " "))
        return words.select(key, F.explode(F.array_distinct(runs)).alias("g"))

    shared = grams(t.documents, "doc_id").join(grams(t.benchmark, "item_id"), "g")
    return shared.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query("""
    WITH v AS (SELECT DISTINCT lower(string_split(p_name, ' ')[-1]) AS g, lower(p_name) AS category FROM part)
    SELECT category, 'Allowed labels: ' || array_to_string(list_sort(list_append(o.options, 'none')), ', ') || '.' AS question, len(o.options) + 1 AS n
    FROM v JOIN (SELECT g, list(category) AS options FROM v GROUP BY 1) o USING (g)""")
def contrastive_questions(t: Tables) -> DataFrame:
    groups = t.part.select(F.element_at(F.split("p_name", " "), -1).alias("kind"), "p_name")
    found = review.contrastive_options(groups, "kind", "p_name")
    return found.select("category", review.contrastive_question(F.col("options")).alias("question"), F.size("options").cast("long").alias("n"))


_CASCADE = """
    WITH b AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'Yes.' ELSE 'no' END AS prediction, CASE WHEN toxic = 1 OR doc_id % 4 = 0 THEN 'no' ELSE 'yes' END AS gt_answer FROM labels),
    j AS (SELECT id, id % 5 AS k FROM b WHERE id % 3 > 0),
    r AS (SELECT id, CASE k WHEN 0 THEN 'Cat ' WHEN 1 THEN 'dog' WHEN 2 THEN 'none' WHEN 3 THEN 'a cat' ELSE 'cat' END AS answer FROM j),
    f AS (SELECT b.id, gt_answer, CASE WHEN prediction = 'no' THEN 'no' ELSE 'yes' END AS was, CASE WHEN prediction = 'no' AND j.id IS NOT NULL AND lower(trim(answer)) IN ('cat', 'dog', 'none') THEN lower(trim(answer)) END AS selected, j.id IS NOT NULL AS job FROM b LEFT JOIN j USING (id) LEFT JOIN r USING (id)),
    o AS (SELECT *, CASE WHEN selected = 'cat' THEN 'yes' ELSE was END AS final_answer FROM f)
    SELECT id, selected, final_answer, CASE WHEN was = 'no' AND job AND selected = 'cat' THEN 'promoted_by_contrastive_target_match' WHEN was = 'no' AND job AND selected IS NULL THEN 'negative_preserved_invalid_contrastive_answer'
           WHEN was = 'no' AND job THEN 'negative_preserved_by_contrastive_rejection' WHEN was = 'yes' THEN 'positive_preserved_without_negative_recheck' ELSE 'baseline_unchanged' END AS status,
           CASE WHEN final_answer = was THEN 'unchanged' WHEN was <> gt_answer THEN 'beneficial' ELSE 'harmful' END AS correction FROM o"""


@query(_CASCADE)
def contrastive_cascade(t: Tables) -> DataFrame:
    id_ = F.col("doc_id")
    right = F.when((F.col("toxic") == 1) | (id_ % 4 == 0), "no").otherwise("yes")
    baseline = t.labels.select(id_.alias("id"), F.when(F.col("quality") == 1, "Yes.").otherwise("no").alias("prediction"), right.alias("gt_answer"))
    asked = baseline.where("id % 3 > 0")
    jobs = asked.select("id", F.concat(F.lit("v3-"), F.col("id").cast("string")).alias("v3_key"), F.lit("cat").alias("object"), F.array(*map(F.lit, ("cat", "dog", "none"))).alias("options"))
    said = F.get(F.array(*map(F.lit, ("Cat ", "dog", "none", "a cat", "cat"))), (F.col("id") % 5).cast("int"))
    reviews = asked.select(F.concat(F.lit("v3-"), F.col("id").cast("string")).alias("v3_key"), said.alias("answer"))
    return review.contrastive_cascade(baseline, jobs, reviews).select("id", "selected", "final_answer", "status", "correction")


@query("""
    WITH e AS (SELECT event_id, event_type AS task_type, CASE WHEN value > 20 THEN 'yes' WHEN value > 5 THEN 'no' END AS v, CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS d FROM events)
    SELECT event_id, CASE WHEN task_type IN ('click', 'view') THEN 'grounded' WHEN task_type = 'error' THEN 'listing' ELSE 'consensus' END AS mode, 'c-' || task_type AS candidate_id,
           CASE WHEN task_type = 'error' THEN CASE WHEN v IS NULL THEN '' ELSE 'event, ' || v END WHEN task_type IN ('click', 'view') THEN d ELSE coalesce(v, d) END AS forced,
           CASE WHEN task_type = 'error' THEN 'event, ' || v WHEN task_type IN ('click', 'view') THEN d WHEN v = d THEN d END AS selective FROM e""")
def locked_policy(t: Tables) -> DataFrame:
    """Each kind of event by the policy that is locked for it."""
    v = F.when(F.col("value") > 20, "yes").when(F.col("value") > 5, "no")
    d = F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no")
    named = F.when(v.isNotNull(), F.array(F.lit("event"), v)).otherwise(F.array().cast("array<string>"))
    kinds = [(k, "grounded" if k in ("click", "view") else "listing" if k == "error" else "consensus", f"c-{k}") for k in ("click", "view", "error", "purchase", "signup")]
    policies = t.spark.createDataFrame(kinds, "task_type string, mode string, candidate_id string")
    modes = {
        "grounded": F.struct(d.alias("forced"), d.alias("selective"), F.lit("grounded").alias("status")), "listing": review.listing_policy(named),
        "consensus": F.struct(F.coalesce(v, d).alias("forced"), F.when(v == d, d).alias("selective"), F.lit("consensus").alias("status")),
    }
    return review.locked_answers(t.events.withColumnRenamed("event_type", "task_type"), policies, modes).select("event_id", "mode", "candidate_id", "forced", "selective")


@query(f"""{_GREEDY}, s AS (SELECT image AS id, sum(gt) AS gt, sum(predicted) AS predicted, sum(tp) AS tp FROM m GROUP BY 1),
    j AS (SELECT o_orderkey AS id, o_orderpriority AS part, o_orderstatus = 'F' AS ok, coalesce(gt, 0) AS gt, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp FROM orders LEFT JOIN s ON id = o_orderkey),
    f AS (SELECT *, CASE WHEN gt > 0 THEN tp > 0 ELSE predicted = 0 END AS supported, CASE WHEN gt > 0 THEN tp = gt ELSE predicted = 0 END AS complete FROM j)
    SELECT part, count(*) AS n, round(avg(ok::INT), 6) AS accuracy, round(avg(supported::INT), 6) AS support_rate, round(avg(complete::INT), 6) AS complete_rate, round(avg((ok AND supported)::INT), 6) AS success_rate,
           round(avg((ok AND complete)::INT), 6) AS complete_success_rate, sum(tp)::BIGINT AS tp, sum(predicted - tp)::BIGINT AS fp, sum(gt - tp)::BIGINT AS fn, round(sum(tp) / sum(predicted), 6) AS "precision", round(sum(tp) / sum(gt), 6) AS recall,
           round(2 * sum(tp) / (sum(gt) + sum(predicted)), 6) AS f1 FROM f GROUP BY 1""")
def live_summary(t: Tables) -> DataFrame:
    rows = lines(t).select(F.col("image").alias("id"), "category", "idx", "box", "score", "side")
    samples = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("part"), (F.col("o_orderstatus") == "F").alias("is_correct"))
    scored = live.evidence_success(samples, rows.where("side = 'F'"), rows.where("side = 'O'"), threshold=0.3)
    return live.live_summary(scored, ["part"])


@query("""
    WITH c AS (SELECT row_number() OVER (ORDER BY p_type) AS id, p_type AS name FROM (SELECT DISTINCT p_type FROM part)),
    a AS (SELECT l_orderkey AS image_id, id AS category_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN c ON p_type = name),
    q AS (SELECT DISTINCT l_orderkey AS image_id, p_type AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1)
    SELECT image_id, category_id, count(*) AS n FROM a JOIN c ON category_id = id JOIN q USING (image_id, name) GROUP BY 1, 2""")
def oracle_annotations(t: Tables) -> DataFrame:
    """An order's lines are an image's annotations, and the types of its first lines are asked for."""
    named = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    names = sorted(r["p_type"] for r in t.part.select("p_type").distinct().collect())  # six types
    categories = t.spark.createDataFrame(list(enumerate(names, 1)), "id bigint, name string")
    annotations = named.join(categories, F.col("p_type") == F.col("name")).select(F.col("l_orderkey").alias("image_id"), F.col("id").alias("category_id"))
    questions = named.where("l_linenumber = 1").select(F.col("l_orderkey").alias("image_id"), F.lit("object_listing").alias("task_type"), F.array("p_type").alias("categories"))
    return live.oracle_annotations(annotations, categories, questions).groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT l_orderkey AS image_id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS category_id, round(x2 - l_quantity, 4) AS width, CASE WHEN l_returnflag = 'R' THEN 'unmapped_label' WHEN x2 < l_quantity THEN 'invalid_bbox' END AS skipped, count(*) AS n
    FROM (SELECT *, CASE WHEN l_tax > 0.06 THEN l_quantity - 1 ELSE l_quantity + 10 END AS x2 FROM lineitem) WHERE l_returnflag <> 'R' AND NOT x2 < l_quantity GROUP BY ALL
    UNION ALL SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END, NULL, CASE WHEN l_returnflag = 'R' THEN 'unmapped_label' ELSE 'invalid_bbox' END, count(*) FROM lineitem WHERE l_returnflag = 'R' OR l_tax > 0.06 GROUP BY ALL""")
def coco_results(t: Tables) -> DataFrame:
    categories = t.spark.createDataFrame([(1, "A"), (2, "N")], "id int, name string")
    x2 = F.when(F.col("l_tax") > 0.06, F.col("l_quantity") - 1).otherwise(F.col("l_quantity") + 10)
    found = t.lineitem.select(F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("class_name"), F.array(F.col("l_quantity"), F.lit(0.0), x2, F.lit(5.0)).alias("box"), F.col("l_discount").alias("score"))
    found = found.repartition(partitions(t.lineitem), "image_id")  # groups are nearly as many as rows
    return live.coco_results(found, categories).groupBy("image_id", "category_id", F.get("bbox", F.lit(2)).alias("width"), "skipped").agg(F.count(F.lit(1)).alias("n"))


@query()
def multilabel_split(t: Tables) -> DataFrame:
    """Orders by the types and sizes of their parts: 20 of them, balanced over all features. Each pick depends on those
    before it; a test holds it against the same choice made in plain Python."""
    kind = t.part.select("p_partkey", F.concat(F.lit("category:"), "p_type").alias("c"), F.concat(F.lit("size:"), (F.col("p_size") % 3).cast("string")).alias("s"))
    named = t.lineitem.select("l_orderkey", "l_partkey").join(kind, F.col("l_partkey") == F.col("p_partkey"))
    features = named.groupBy("l_orderkey").agg(F.array_union(F.collect_set("c"), F.collect_set("s")).alias("features"))
    return selection.multilabel_split(features, "l_orderkey", "features", 20, "split").select("l_orderkey", "split")


@query()
def diverse_selection(t: Tables) -> DataFrame:
    """Five hard orders of each priority, with a bonus for tags and types that few of those chosen before have."""
    kind = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("categories"))
    rows = _difficulty(t).select("l_orderkey", "tags", "score").join(kind, "l_orderkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return selection.diverse_selection(rows, "l_orderkey", "o_orderpriority", "score", "tags", "categories", dict.fromkeys(priorities, 5), "hard").select("l_orderkey", "o_orderpriority", "rank")


@query("""
    WITH e AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS entity, l_returnflag AS category, l_quantity AS area FROM lineitem),
    k AS (SELECT *, count(*) OVER (PARTITION BY image, category) AS n, row_number() OVER w AS r, lead(area) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY image, category ORDER BY area DESC, entity)),
    u AS (SELECT image, entity, category, CASE WHEN n = 1 THEN 'unique_category' WHEN r = 1 AND area > nxt + 1e-8 THEN 'largest_instance' END AS rule FROM k)
    SELECT s.image, s.entity AS subject, 'to the left of' AS predicate, o.entity AS object, s.rule AS subject_rule, o.rule AS object_rule FROM u s JOIN u o ON s.image = o.image AND o.entity = s.entity + 1 AND s.category <> o.category
    WHERE s.rule IS NOT NULL AND o.rule IS NOT NULL""")
def safe_relations(t: Tables) -> DataFrame:
    """Each line of an order is left of the next one."""
    quantity = F.element_at("box", 1)
    parts = partitions(t.lineitem)
    entities = lines(t, parts).select("image", F.col("idx").alias("entity"), "category", quantity.alias("area"))
    last = entities.groupBy("image").agg(F.max("entity").alias("m"))
    relations = entities.join(last, "image").where("entity < m").select("image", F.col("entity").alias("subject"), F.lit("to the left of").alias("predicate"), (F.col("entity") + 1).alias("object"))
    return candidates.safe_relations(entities, relations, parts=parts).select("image", "subject", "predicate", "object", "subject_rule", "object_rule")


@query("""
    WITH o AS (SELECT l_orderkey AS image, p_type AS category, l_quantity / 1000 AS area, l_returnflag = 'R' AS occluded, l_tax > 0.07 AS truncated, l_discount > 0.095 AS group_of FROM lineitem JOIN part ON l_partkey = p_partkey),
    r AS (SELECT o_orderkey AS image, count(*) AS n_relations FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), h AS (SELECT o.* FROM o JOIN r USING (image)),
    c AS (SELECT category, count(DISTINCT image) AS images FROM h GROUP BY 1), t AS (SELECT quantile_disc(images, 0.2) AS threshold FROM c),
    k AS (SELECT image, category, count(*) AS n FROM h GROUP BY 1, 2),
    e AS (SELECT image, min(area) AS a, bool_or(occluded) AS oc, bool_or(truncated) AS tr, bool_or(group_of) AS gr, count(*) AS n_objects FROM h GROUP BY 1),
    g AS (SELECT image, list_sort(list(category)) AS categories, max(n) AS most, count(*) AS kinds, bool_or(images <= threshold) AS rare FROM k JOIN c USING (category), t GROUP BY 1),
    w AS (SELECT image, categories, n_objects, n_relations, list_filter([CASE WHEN a <= 0.005 THEN {'n': 'tiny_object', 'w': 2.0} END, CASE WHEN a > 0.005 AND a <= 0.02 THEN {'n': 'small_object', 'w': 1.0} END, CASE WHEN oc THEN {'n': 'occluded', 'w': 1.5} END,
          CASE WHEN tr THEN {'n': 'truncated', 'w': 1.0} END, CASE WHEN gr THEN {'n': 'group_of', 'w': 1.0} END, CASE WHEN n_objects >= 8 THEN {'n': 'dense_instances', 'w': 1.5} END, CASE WHEN most >= 3 THEN {'n': 'repeated_category', 'w': 1.0} END,
          CASE WHEN kinds >= 5 THEN {'n': 'category_diversity', 'w': 1.0} END, CASE WHEN rare THEN {'n': 'long_tail_category', 'w': 2.0} END, CASE WHEN n_relations >= 1 THEN {'n': 'spatial_relation', 'w': 1.5} END, CASE WHEN n_relations >= 5 THEN {'n': 'dense_relations', 'w': 1.0} END], lambda v: v IS NOT NULL) AS g
          FROM e JOIN g USING (image) JOIN r USING (image))
    SELECT image, array_to_string(categories, ';') AS categories, n_objects, n_relations, array_to_string(list_transform(g, lambda v: v.n), ';') AS tags, list_sum(list_transform(g, lambda v: v.w))::DOUBLE AS score FROM w""")
def image_candidates(t: Tables) -> DataFrame:
    """An order is an image with a relation if it is finished; the types of its parts are the categories."""
    parts = partitions(t.lineitem)
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_tax", "l_discount").repartition(parts, "l_partkey")
    named = lines.join(t.part.select("p_partkey", "p_type").repartition(parts, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    objects = named.select(F.col("l_orderkey").alias("image"), F.col("p_type").alias("category"), (F.col("l_quantity") / 1000).alias("area"), (F.col("l_returnflag") == "R").alias("occluded"), (F.col("l_tax") > 0.07).alias("truncated"), (F.col("l_discount") > 0.095).alias("group_of"))
    found = candidates.image_candidates(objects, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image")), parts=parts)
    return found.withColumns({"categories": F.array_join("categories", ";"), "tags": F.array_join("tags", ";")})


@query("""
    WITH q AS (SELECT p_partkey, p_name, p_brand, p_partkey % 3 AS k, p_size > 25 AS big FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN 'kept' WHEN 1 THEN 'Treat both named instances as present in this image, even if a category label is broad. Compare their visual center positions. Where is the center of the ' || CASE WHEN big THEN 'largest ' ELSE '' END
        || 'visible ' || p_name || ' relative to the center of the visible ' || p_brand || '? Reply with exactly one label: above; below; to the left of; to the right of.'
      ELSE 'Treat both named object instances as present in this image, even if a category label is broad or unusual. Judge their depicted spatial relationship, not category definitions or real-world size. Where is the '
        || CASE WHEN big THEN 'largest ' ELSE '' END || 'visible ' || p_name || ' relative to the visible ' || p_brand || '? Reply with exactly one label: above; below; to the left of; to the right of.' END AS question FROM q""")
def relation_prompts(t: Tables) -> DataFrame:
    """Relation questions between a part and its brand, by the prompt of their source."""
    k = F.col("p_partkey") % 3
    rule = F.struct(F.when(F.col("p_size") > 25, "largest_instance").otherwise("unique_category").alias("subject"), F.lit("unique_category").alias("object"))
    asked = t.part.select(
        "p_partkey", F.when(k == 1, "boxes").otherwise("graph").alias("source"), F.when(k == 0, "object_listing").otherwise("spatial_relation").alias("task_type"), F.lit("kept").alias("question"),
        F.array("p_name", "p_brand").alias("categories"), rule.alias("rules"),
    )
    policies = t.spark.createDataFrame([("boxes", "v2", True), ("graph", "v3", True)], "source string, variant string, passed boolean")
    return questions.source_prompts(asked, policies).select("p_partkey", "question")


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'structured_vlm_coco80' ELSE 'question_parser' END AS source,
           CASE p_partkey % 3 WHEN 0 THEN array_to_string(list_sort([lower(p_name), 'zebra']), '. ') || '.' WHEN 1 THEN lower(p_name) || '.' ELSE array_to_string(list_sort([lower(p_name), lower(p_type)]), '. ') || '.' END AS prompt FROM part""")
def query_plans(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    task = F.when(k == 0, "object_listing").when(k == 1, "object_existence").otherwise("spatial_relation")
    question = F.when(k == 1, F.concat(F.lit("Is there a "), "p_name", F.lit(" in the image?"))).otherwise(F.concat(F.lit("Where is the "), "p_name", F.lit(" relative to the "), "p_type", F.lit("?")))
    plan = questions.query_plan(question, task, F.when(k == 0, F.array("p_name", F.lit("Zebra"), F.lit("zebra"))))
    return t.part.select("p_partkey", plan.alias("p")).select("p_partkey", "p.source", "p.prompt")


@query(f"""
    WITH q AS (SELECT o_orderkey, o_orderstatus = 'F' AS no FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx FROM lineitem),
    r AS (SELECT l_orderkey, idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, idx) AS rank FROM l JOIN q ON l_orderkey = o_orderkey WHERE no)
    SELECT printf('q%d__annotation-%03d', l_orderkey, idx) AS candidate_key, rank::INTEGER AS rank FROM r WHERE rank <= 2""")
def review_jobs(t: Tables) -> DataFrame:
    """The two dearest lines of each finished order are reviewed."""
    key = lambda c: F.concat(F.lit("q"), F.col(c).cast("string")).alias("query_key")
    answers = t.orders.select(key("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "No.").otherwise("Yes").alias("prediction"), F.lit("line").alias("object"))
    found = lines(t).select(key("image"), "idx", "score")
    return questions.review_jobs(answers, found, F.concat(F.lit("Is this a "), "object", F.lit("?")), 2).select("candidate_key", "rank")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'k: ' || (props::JSON ->> 'k') || ' -> null' END AS differences FROM events""")
def config_differences(t: Tables) -> DataFrame:
    current = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit('{"other": 1}'))
    return t.events.select("event_id", F.array_join(runs.config_differences(F.col("props"), current, ["k", "missing"]), "; ").alias("differences"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE event_type IN ('click', 'error')) WHERE r <= 25")
def select_records(t: Tables) -> DataFrame:
    return questions.select_records(t.events.select("event_type", "event_id"), "event_id", "event_type", "event_id", ["click", "error"], 25)


@query("""
    WITH k AS (SELECT l_orderkey, l_returnflag, bool_or(l_tax > 0.07 OR l_discount > 0.09) AS hard, min(l_quantity) AS a FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey AS image, l_returnflag AS category, row_number() OVER (PARTITION BY l_orderkey ORDER BY hard DESC, a, l_returnflag)::INTEGER AS rank FROM k""")
def present_ranking(t: Tables) -> DataFrame:
    objects = t.lineitem.select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("area"), (F.col("l_tax") > 0.07).alias("occluded"), (F.col("l_discount") > 0.09).alias("truncated"))
    return questions.present_ranking(objects)
