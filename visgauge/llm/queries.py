"""The queries over the operators of this subpackage, with production parameters, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visgauge.llm import bpe, chat
from visgauge.llm.alignment import align_tokenizers
from visgauge.llm.common import table
from visgauge.llm.decontaminate import contaminated
from visgauge.llm.embeddings import embedding_near_duplicates
from visgauge.llm.fim import fill_in_middle, restore_texts
from visgauge.llm.html import extract_main_text
from visgauge.llm.langid import fit_languages, identify_languages
from visgauge.llm.lines import drop_boilerplate
from visgauge.llm.packing import pack, pieces_of
from visgauge.llm.quality import fit_quality, score_quality
from visgauge.llm.simhash import simhash_components
from visgauge.llm.suffixes import remove_repeated_strings


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that nothing is learned from; a null id is in neither fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out()))
    return identify_languages(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_strings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: A conversation that tries to pass for markup.
TRAP = "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    back = chat.read_back(chat.format_conversations(turns, path), path)
    digests = {"turns_sha256": F.sha2("turns", 256), "loss_chars": F.length("loss_text").cast("long"), "loss_sha256": F.sha2("loss_text", 256)}
    return back.withColumns(digests).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs.where(~held_out()), labels.where(~held_out()))
    scored = score_quality(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document for each benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the length and digest of what is left of the text."""
    kept = drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


#: The id that ends a document in a packed sequence.
END_ID = 1


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces_of(pack(encoded, END_ID))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = restore_texts(fill_in_middle(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_dedup, op2_bpe, op3_simhash_dedup, op4_language_id, op5_suffix_dedup, op6_chat_format, op7_quality, op8_html_extract, op9_decontaminate, op10_line_dedup, op11_packing, op12_token_alignment, op13_fill_in_middle)}

SQL: dict[str, str] = {
    "op10_line_dedup": """
        WITH pages AS (SELECT row_number() OVER () AS r, source, string_split(text, chr(10)) AS ls FROM documents),
        lines AS (SELECT r, source, unnest(ls) AS line FROM pages),
        totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
        counts AS (SELECT source, trim(line) AS line, count(DISTINCT r) AS n_pages FROM lines WHERE trim(line) <> '' GROUP BY 1, 2),
        dropped AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
                    WHERE n_pages >= 5 AND n_pages > 0.1 * host_pages),
        lists AS (SELECT source, list(line) AS drops FROM dropped GROUP BY source),
        kept AS (SELECT doc_id, string_split(text, chr(10)) AS lines,
                        list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(drops, trim(x)), false)) AS stays
                 FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
        SELECT doc_id, len(lines)::INTEGER AS n_lines, (len(lines) - len(stays))::INTEGER AS n_dropped,
               length(array_to_string(stays, chr(10)))::INTEGER AS n_chars_kept, sha256(array_to_string(stays, chr(10))) AS kept_sha256
        FROM kept""",
    "op13_fill_in_middle": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digits FROM documents),
        numbers AS (SELECT *, len(text) - len(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS n,
                           ('0x' || substr(digits, 1, 8))::BIGINT AS h1, ('0x' || substr(digits, 9, 8))::BIGINT AS h2, ('0x' || substr(digits, 25, 8))::BIGINT AS h4 FROM docs),
        cuts AS (SELECT *, string_split(text, chr(10)) AS ls, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                        text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM numbers),
        heads AS (SELECT *, left(array_to_string(ls[1:a], chr(10)) || CASE WHEN a > 0 THEN chr(10) ELSE '' END, len(text)) AS p,
                         left(array_to_string(ls[1:b], chr(10)) || CASE WHEN b > 0 THEN chr(10) ELSE '' END, len(text)) AS pm FROM cuts),
        parts AS (SELECT *, substr(pm, len(p) + 1) AS m, substr(text, len(pm) + 1) AS s FROM heads)
        SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
               CASE WHEN NOT plain THEN len(p) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN len(m) END::BIGINT AS middle_chars,
               sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
}
