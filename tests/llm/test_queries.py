"""The registered queries over a small folder of all tables, each against a plain version of its contract."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import DOC, components, corpus, edited, prose
from tests.llm.test_pairs import plain_fingerprint
from tests.llm.test_texts import LANGUAGES, plain_removal, plain_similarity
from visgauge.llm import chat, queries
from visgauge.llm.decontaminate import words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def in_held_out_fold(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(71)
    docs = [(i, t, None, s, n) for i, t, _, s, n in corpus(5)]
    for k in range(240):
        lang = rnd.choice(sorted(LANGUAGES))
        text = prose(rnd, rnd.randrange(20, 60), LANGUAGES[lang])
        if k % 3 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        docs.append((1000 + k, text, lang, f"s{k % 3}", len(text)))
    items = [(k, prose(rnd, rnd.randrange(12, 40))) for k in range(6)]
    docs += [(2000 + k, prose(rnd, 30) + " " + edited(rnd, t, k % 2) + " " + prose(rnd, 30), "xx", "s1", 1) for k, t in items]
    docs += [(3000 + k, f"menu of s2\nown {k} {prose(rnd, 9)}\nmenu of s2", "xx", "s2", 1) for k in range(60)] + [(4000, "", "xx", "s2", 0), (4001, None, "xx", None, None)]
    labels = [(1000 + k, int(k % 3 > 0), 0) for k in range(240)]
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    vectors = [(i, (base[i % 12] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.3])).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(150)] + [(900, None, 1), (901, [0.0] * 16, 1)]
    talks = [(c, t, ["system", "user", "assistant"][t % 3], rnd.choice([prose(rnd, 5), "a\\<|endoftext|>b", "", None, "é\n"])) for c in range(8) for t in range(rnd.randrange(1, 7))]
    pages = [(i, f"http://h.example/{i}", f"<body><div>menu</div><article><p>Text &amp; {i}</p></article></body>") for i in range(9)] + [(9, None, None)]
    return {"documents": docs, "labels": labels, "embeddings": vectors, "benchmark": items, "conversations": talks, "pages": pages}


SCHEMAS = {
    "documents": DOC, "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int", "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string", "pages": "page_id long, url string, html string",
}


def write(spark, tables, folder) -> str:
    for name, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[name]).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    return write(spark, tables, tmp_path_factory.mktemp("all"))


def rows_of(spark, folder, name, **types):
    df = queries.QUERIES[name](spark, folder)
    assert {c: dict(df.dtypes).get(c) for c in types} == types
    return df.collect()


def test_op1(spark, folder, tables):
    found = rows_of(spark, folder, "op1_embedding_dedup", vec_id="bigint", n_links="bigint", component_id="bigint", kept="boolean")
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v, label in tables["embeddings"] if v and any(v) and label is not None}
    label = {i: x for i, _, x in tables["embeddings"]}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if label[a] == label[b] and good[a] @ good[b] >= 0.98]
    of = components([r[0] for r in tables["embeddings"]], links)
    degree = Counter(x for p in links for x in p)
    assert len(links) > 100
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (degree[i], of[i], of[i] == i) for i in of}


def test_op2(spark, folder, tables):
    found = {r.doc_id: r for r in rows_of(spark, folder, "op2_bpe", doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")}
    library = Tokenizer.from_file(PATH)
    assert len(found) == len(tables["documents"])
    for i, text, *_ in tables["documents"]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert found[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_op3(spark, folder, tables):
    found = rows_of(spark, folder, "op3_simhash_dedup", doc_id="bigint", fingerprint="string", component_id="bigint")
    prints = {i: plain_fingerprint(t) for i, t, *_ in tables["documents"]}
    of = components(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{p:016x}", of[i]) for i, p in prints.items()}


def test_op4(spark, folder, tables, tmp_path):
    types = dict(doc_id="bigint", held_out="boolean", lang_pred="string", score="double")
    found = {r.doc_id: r for r in rows_of(spark, folder, "op4_language_id", **types)}
    assert {i: r.held_out for i, r in found.items()} == {i: in_held_out_fold(i) for i, *_ in tables["documents"]}
    assert all(0 <= r.score <= 1 for r in found.values())
    assert (found[4000].lang_pred, found[4001].lang_pred) == ("und", "und")
    known = [(i, lang) for i, _, lang, *_ in tables["documents"] if 1000 <= i < 2000]
    held = [(i, lang) for i, lang in known if in_held_out_fold(i)]
    assert len(held) > 30 and sum(found[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    # nothing is learned from the other fold, nor from source and id
    odd = [(i, t, "zz" if in_held_out_fold(i) else lang, "other", n) for i, t, lang, _, n in tables["documents"]]
    again = rows_of(spark, write(spark, tables | {"documents": odd}, tmp_path), "op4_language_id", **types)
    assert {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in again} == {i: (r.lang_pred, round(r.score, 4)) for i, r in found.items()}


def test_op5(spark, folder, tables):
    found = rows_of(spark, folder, "op5_suffix_dedup", doc_id="bigint", n_bytes="bigint", n_removed="bigint", n_spans="bigint", kept_sha256="string")
    expected = plain_removal([(i, t) for i, t, *_ in tables["documents"]])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == {i: (n, gone, spans, sha(kept)) for i, n, gone, spans, kept in expected}
    assert sum(r.n_removed > 0 for r in found) > 5


def test_op6(spark, folder, tables):
    found = {r.conv_id: r for r in rows_of(spark, folder, "op6_chat_format", conv_id="bigint", n_turns="bigint", turns_sha256="string", loss_chars="bigint", loss_sha256="string", formatted_chars="bigint")}
    talks = tables["conversations"] + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    assert set(found) == {t[0] for t in talks}
    for conv in found:
        turns = [(r, x or "") for c, _, r, x in sorted(talks, key=lambda t: t[:2]) if c == conv]
        loss = "".join(x for r, x in turns if r == "assistant")
        row = found[conv]
        assert (row.n_turns, row.turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))
        assert row.formatted_chars == len(chat.render(turns)[0])


def test_op7(spark, folder, tables, tmp_path):
    types = dict(doc_id="bigint", held_out="boolean", score="double", predicted="int")
    found = {r.doc_id: r for r in rows_of(spark, folder, "op7_quality", **types)}
    assert {i: r.held_out for i, r in found.items()} == {i: in_held_out_fold(i) for i, *_ in tables["documents"]}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    good, bad = ([found[i].score for i, q, _ in tables["labels"] if q == want and in_held_out_fold(i)] for want in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    other = [(i, 1 - q if in_held_out_fold(i) else q, t) for i, q, t in tables["labels"]]
    odd = [(i, t, "xx", "other", n) for i, t, _, _, n in tables["documents"]]
    again = rows_of(spark, write(spark, tables | {"labels": other, "documents": odd}, tmp_path), "op7_quality", **types)
    assert {r.doc_id: round(r.score, 4) for r in again} == {i: round(r.score, 4) for i, r in found.items()}


def test_op8(spark, folder):
    found = rows_of(spark, folder, "op8_html_extract", page_id="bigint", url="string", text="string", n_chars="bigint")
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in found} == {i: (f"http://h.example/{i}", f"Text & {i}", 8) for i in range(9)} | {9: (None, "", 0)}


def test_op9(spark, folder, tables):
    found = {(r.doc_id, r.item_id): r.similarity for r in rows_of(spark, folder, "op9_decontaminate", doc_id="bigint", item_id="bigint")}
    all_ = {(d, i): plain_similarity(words_of(t), words_of(item)) for d, t, *_ in tables["documents"] for i, item in tables["benchmark"]}
    expected = {k: s for k, s in all_.items() if s >= 0.8}
    assert len(expected) >= 4
    assert found == {k: pytest.approx(s) for k, s in expected.items()}


def test_op10(spark, folder, tables):
    found = {r.doc_id: r for r in rows_of(spark, folder, "op10_line_dedup", doc_id="bigint", n_lines="int", n_dropped="int", n_chars_kept="int", kept_sha256="string")}
    pages = {i: (s, t.split("\n") if t is not None else None) for i, t, _, s, _ in tables["documents"]}
    hosts = Counter(s for s, _ in pages.values())
    on = Counter((s, x) for s, lines in pages.values() for x in {y.strip(" ") for y in lines or []} if x)
    drop = {k for k, n in on.items() if n >= 5 and n > 0.1 * hosts[k[0]]}
    assert drop
    for i, (s, lines) in pages.items():
        kept = None if lines is None else [x for x in lines if (s, x.strip(" ")) not in drop]
        assert (found[i].n_lines, found[i].n_dropped) == ((0, 0) if lines is None else (len(lines), len(lines) - len(kept)))
        assert found[i].kept_sha256 == (None if lines is None else sha("\n".join(kept)))
