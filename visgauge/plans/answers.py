"""Queries on texts: normalising, parsing, extraction, keys and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.functions import hashing, text
from visgauge.operators.scoring import binary_evaluation
from visgauge.plans.registry import Tables, query

#: Words of part names as a vocabulary: `bolt` and `small bolt` overlap, the longer one counts.
PARTS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "widget", "small bolt", "red bolt"]
_NORMAL = "trim(regexp_replace(regexp_replace(replace(lower({0}), '_', '-'), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
#: An answer of a model for each labelled document: what it says depends on the toxic flag, how on the language.
_ANSWERS = """
    SELECT l.doc_id, d.lang, d.source, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS target,
           CASE toxic WHEN 0 THEN 'Yes' ELSE 'No' END || CASE lang WHEN 'fr' THEN ', it is.' WHEN 'de' THEN ' or no' WHEN 'es' THEN '. Not sure' ELSE '' END AS answer
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def answers(t: Tables) -> DataFrame:
    said = F.when(F.col("toxic") == 0, "Yes").otherwise("No")
    how = F.when(F.col("lang") == "fr", ", it is.").when(F.col("lang") == "de", " or no").when(F.col("lang") == "es", ". Not sure").otherwise("")
    rows = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    return rows.select("doc_id", "lang", "source", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("target"), F.concat(said, how).alias("answer"))


@query(f"SELECT doc_id, length(n)::INTEGER AS n_chars, md5(n) AS digest FROM (SELECT doc_id, {_NORMAL.format('text')} AS n FROM documents)")
def normalize_text(t: Tables) -> DataFrame:
    n = t.documents.select("doc_id", text.normalize_text(F.col("text")).alias("n"))
    return n.select("doc_id", F.length("n").alias("n_chars"), F.md5("n").alias("digest"))


@query("SELECT p_partkey, trim(regexp_replace(replace(lower(coalesce(p_brand || '_' || p_name, '')), '_', ' '), '\\s+', ' ', 'g')) AS name FROM part")
def canonical_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.canonical_text(F.concat("p_brand", F.lit("_"), "p_name")).alias("name"))


@query(f"""
    WITH a AS ({_ANSWERS}), n AS (SELECT *, list_distinct(regexp_extract_all({_NORMAL.format("answer")}, '\\b(yes|no)\\b')) AS found FROM a)
    SELECT doc_id, CASE WHEN len(found) = 1 THEN found[1] END AS strict,
           CASE WHEN list_has_any(string_split(replace(string_split(answer, '.')[1], ',', ''), ' '), ['No', 'no', 'not']) THEN 'no' ELSE 'yes' END AS official
    FROM n""")
def parse_yes_no(t: Tables) -> DataFrame:
    a = F.col("answer")
    return answers(t).select("doc_id", text.parse_yes_no(a).alias("strict"), text.official_answer(a).alias("official"))


@query(f"""
    WITH a AS ({_ANSWERS}), n AS (SELECT *, list_distinct(regexp_extract_all({_NORMAL.format("answer")}, '\\b(yes|no)\\b')) AS found,
        CASE WHEN list_has_any(string_split(replace(string_split(answer, '.')[1], ',', ''), ' '), ['No', 'no', 'not']) THEN 'no' ELSE 'yes' END AS official FROM a)
    SELECT doc_id, official = target AS is_correct, len(found) = 1 AS parse_valid,
           CASE WHEN target = 'yes' THEN CASE official WHEN 'yes' THEN 'TP' ELSE 'FN' END ELSE CASE official WHEN 'yes' THEN 'FP' ELSE 'TN' END END AS outcome
    FROM n""")
def binary_outcomes(t: Tables) -> DataFrame:
    return answers(t).select("doc_id", binary_evaluation(F.col("answer"), F.col("target")).alias("e")).select("doc_id", "e.is_correct", "e.parse_valid", "e.outcome")


@query(f"""
    WITH q AS (SELECT o_orderkey, 'The cup is ' || CASE o_orderkey % 6 WHEN 0 THEN 'left of' WHEN 1 THEN 'on top of' WHEN 2 THEN 'under and above' WHEN 3 THEN 'beneath'
                      WHEN 4 THEN 'ON THE RIGHT OF' ELSE 'near' END || ' the ' || o_orderpriority AS a FROM orders),
    n AS (SELECT o_orderkey, {_NORMAL.format("a")} AS x FROM q),
    f AS (SELECT o_orderkey, list_filter([CASE WHEN regexp_matches(x, '\\b(to the left of|left of|on the left of)\\b') THEN 'to the left of' END,
            CASE WHEN regexp_matches(x, '\\b(to the right of|right of|on the right of)\\b') THEN 'to the right of' END,
            CASE WHEN regexp_matches(x, '\\b(above|over|on top of)\\b') THEN 'above' END, CASE WHEN regexp_matches(x, '\\b(below|under|beneath)\\b') THEN 'below' END], lambda v: v IS NOT NULL) AS r FROM n)
    SELECT o_orderkey, CASE WHEN len(r) = 1 THEN r[1] END AS relation FROM f""")
def parse_relation(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    how = F.when(k == 0, "left of").when(k == 1, "on top of").when(k == 2, "under and above").when(k == 3, "beneath").when(k == 4, "ON THE RIGHT OF").otherwise("near")
    answer = F.concat(F.lit("The cup is "), how, F.lit(" the "), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", text.parse_relation(answer).alias("relation"))


@query("""
    WITH w AS (SELECT p_partkey, lower(p_name) AS n FROM part),
    m AS (SELECT p_partkey, CASE WHEN n IN ('small bolt', 'red bolt') THEN n
          ELSE regexp_extract(n, '\\b(anvil|bolt|gear|gizmo|plate|ring|widget)s?\\b', 1) END AS c FROM w)
    SELECT p_partkey, coalesce(c, '') AS categories FROM m""")
def extract_categories(t: Tables) -> DataFrame:
    found = text.extract_categories(F.concat("p_name", F.lit("s")), PARTS, {})
    return t.part.select("p_partkey", F.array_join(found, ";").alias("categories"))


@query("""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'embedded' ELSE 'none' END AS source,
           CASE WHEN event_id % 3 < 2 THEN (props::JSON ->> 'k')::BIGINT END AS k FROM events""")
def recover_json(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Sure: {"), F.col("props"), F.lit(" that is all"))).otherwise(F.replace("props", F.lit("}"), F.lit("")))
    found = t.events.select("event_id", text.recover_json(said).alias("r"))
    return found.select("event_id", "r.source", F.get_json_object("r.json", "$.k").cast("long").alias("k"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT props::JSON ->> 'k') AS keys, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_fields(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(k).alias("keys"), F.sum(k.cast("long")).alias("total"))


@query("""
    SELECT l_orderkey, string_agg(n, '. ' ORDER BY n) || '.' AS prompt
    FROM (SELECT DISTINCT l_orderkey, p_name AS n FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def grounding_prompts(t: Tables) -> DataFrame:
    named = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return named.groupBy("l_orderkey").agg(F.collect_set("p_name").alias("names")).select("l_orderkey", text.grounding_prompt(F.col("names")).alias("prompt"))


@query("""
    SELECT p_partkey, question, nullif(regexp_extract(lower(question), '^is there (?:a|an|any) (.+?) in the image\\?$', 1), '') AS phrase,
           CASE WHEN lower(p_name[1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || p_name AS named
    FROM (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN 'Is there any ' ELSE 'Is there a ' END || p_name || CASE p_partkey % 5 WHEN 0 THEN ' in the room?' ELSE ' in the image?' END AS question FROM part)""")
def object_questions(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    question = F.concat(F.when(k % 4 == 0, "Is there any ").otherwise("Is there a "), F.col("p_name"), F.when(k % 5 == 0, " in the room?").otherwise(" in the image?"))
    rows = t.part.select(k, "p_name", question.alias("question"))
    return rows.select(k, "question", text.object_phrase(F.col("question")).alias("phrase"), text.with_article(F.col("p_name")).alias("named"))


@query("SELECT doc_id, rtrim(text) <> '' AND NOT regexp_matches(rtrim(text), '[.!?)}\\]]$') AS open_ending FROM documents")
def open_endings(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.has_open_ending(F.col("text")).alias("open_ending"))


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'runs/' || s_name || '.json' ELSE '/srv/data/' || s_name || '.json' END AS path,
           replace(lower(s_name), ' ', '-') AS slug, printf('%.2f', s_nationkey / 100.0).replace('.', 'p') AS threshold FROM supplier""")
def portable_paths(t: Tables) -> DataFrame:
    path = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("D:\\work\\project\\runs\\"), F.col("s_name"), F.lit(".json"))).otherwise(F.concat(F.lit("/srv/data/"), F.col("s_name"), F.lit(".json")))
    return t.supplier.select("s_suppkey", text.portable_path(path, "D:\\work\\project").alias("path"), text.slug(F.col("s_name")).alias("slug"), text.threshold_slug(F.col("s_nationkey") / 100.0).alias("threshold"))


@query("""
    SELECT p_partkey, lower(split_part(split_part(p, ';', 1), ', ', 1)) || '|' || lower(split_part(split_part(p, ';', 1), ', ', 2)) AS targets
    FROM (SELECT p_partkey, p_type || ', ' || p_name || ';' || p_type AS p FROM part)""")
def evidence_targets(t: Tables) -> DataFrame:
    said = F.concat("p_type", F.lit(", "), "p_name", F.lit(";"), "p_type")
    return t.part.select("p_partkey", F.array_join(text.manual_targets(said, 6), "|").alias("targets"))


@query("SELECT event_id, substr(sha256(user_id || chr(10) || event_type), 1, 24) AS key FROM events")
def query_keys(t: Tables) -> DataFrame:
    return t.events.select("event_id", hashing.key(F.col("user_id"), F.col("event_type")).alias("key"))


@query("""
    WITH w AS (SELECT DISTINCT p_name FROM part)
    SELECT p_name, CASE WHEN regexp_matches(p_name, '(s|x|z|ch|sh)$') THEN p_name || 'es' WHEN regexp_matches(p_name, '[^aeiou]y$') THEN left(p_name, -1) || 'ies' ELSE p_name || 's' END AS plural FROM w""")
def plurals(t: Tables) -> DataFrame:
    return t.part.select("p_name").distinct().select("p_name", text.pluralize(F.col("p_name")).alias("plural"))
