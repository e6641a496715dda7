"""The pipeline over a small corpus, and the registered queries over it."""

from __future__ import annotations

import itertools
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import DOC, components, edited, prose, python_at_once
from tests.llm.test_pairs import jaccard
from tests.llm.test_texts import LANGUAGES, plain_similarity
from visgauge.llm.decontaminate import decontaminate, words_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    out = tmp_path_factory.mktemp("sf")
    items = [prose(rnd, 30, LANGUAGES["xx"]) for _ in range(5)]
    rows = []
    for i in range(240):
        lang = rnd.choice(["xx", "yy", "zz"])
        rows.append((i, prose(rnd, rnd.randrange(30, 90), LANGUAGES[lang]), lang, rnd.choice(["s0", "s1"]), 0))
    rows = [(i, "the menu of it\n" + t if s == "s0" and i % 2 else t, lang, s, len(t)) for i, t, lang, s, _ in rows]
    extra = [rows[3][1], edited(rnd, rows[4][1], 1), rows[5][1] + " " + items[0].upper(), items[1], None, "", "1234", "ЖЩЮ ЖЪЫ ЩЩЪ " * 40]
    rows += [(300 + k, t, "xx", "s1", len(t or "")) for k, t in enumerate(extra)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, items


def test_run(spark, folder):
    path, rows, items = folder
    left = {i: (t, s) for i, t, _, s, _ in rows if i not in (304, 305, 306, 307)}  # no letters, or no language that it knows
    hosts = {s: [t.split("\n") for t, h in left.values() if h == s] for s in ("s0", "s1")}
    drop = {s: {line for page in pages for line in page if sum(line in p for p in pages) > 0.1 * len(pages) and sum(line in p for p in pages) >= 5} for s, pages in hosts.items()}
    assert drop == {"s0": {"the menu of it"}, "s1": set()}
    texts = {i: "\n".join(line for line in t.split("\n") if line.strip() not in drop[s]) for i, (t, s) in left.items()}
    of = components(texts, [(a, b) for a, b in itertools.combinations(texts, 2) if jaccard(texts[a], texts[b]) >= 0.8])
    texts = {i: t for i, t in texts.items() if of[i] == i}
    assert 300 not in texts
    texts = {i: t for i, t in texts.items() if all(plain_similarity(words_of(t), words_of(item)) < 0.8 for item in items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, path).collect()}
    assert set(found) == set(expected)
    assert found == expected


def test_stages_keep_extra_columns_and_empty_tables(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.selectExpr("*", "1 as rejected", "2 as _row", "3 as doc", "4 as found", "5 as host", "6 as lang_pred", "-7 as n_lines", "8 as n_dropped")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, path).columns == odd.columns, name
        assert stage(spark, odd, path).where("rejected = 1 and n_lines = -7 and n_dropped = 8").count() > 200, name
        assert stage(spark, odd.limit(0), path).count() == 0, name


def test_one_python_worker_of_a_task(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for df in (corpus_pipeline.bpe_encoding(spark, docs, path), __spark_entry__.queries()["op2_bpe"](spark, path)):
        assert python_at_once(df) == 1
    kept = decontaminate(docs, spark.read.parquet(f"{path}/benchmark.parquet"), items_at_once=2)
    assert python_at_once(kept) == 1
    assert {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows if all(plain_similarity(words_of(t), words_of(item)) < 0.8 for item in items)}


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if sum(k.startswith(f"op{n}_") for k in names) != 1] == []
    assert set(__spark_entry__.oracle_sql()) <= set(names)
