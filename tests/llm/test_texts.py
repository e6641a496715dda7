"""Operators that read or rewrite single texts."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import DOC, corpus, edited, prose, python_at_once
from visgauge.llm import bpe, chat, suffixes
from visgauge.llm import decontaminate as decontaminate_module
from visgauge.llm.decontaminate import contaminated, decontaminate, words_of
from visgauge.llm.html import extract_main_text, main_text
from visgauge.llm.langid import fit_languages, identify_languages
from visgauge.llm.lines import drop_boilerplate
from visgauge.llm.quality import fit_quality, score_quality

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "é", "日本", " ", "  ", "\n", "'s", "'", "!!", "<|endoftext|>", "<|endo", "ftext|>", "23", "the", "tion", "\t", "😀", "…"]


@pytest.mark.parametrize("seed", range(4))
def test_tree_encoding_equals_the_library(seed):
    rnd = random.Random(seed)
    voc, library = bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    for _ in range(120):
        some = rnd.sample(PIECES, rnd.choice([1, 2, 4, len(PIECES)]))
        text = "".join(rnd.choice(some) for _ in range(rnd.randrange(1, 250)))
        expected = library.encode(text, add_special_tokens=False).ids
        whole = bpe.concatenate_tree(voc, [voc.encode(t) for t in bpe.leaves(text, rnd.choice([4, 16, 50]))])
        assert whole.tolist() == expected
        assert voc.decode(expected).decode() == library.decode(expected, skip_special_tokens=False)


def test_encode_and_decode(spark):
    rnd = random.Random(2)
    rows = [(i, t) for i, (_, t, *_) in enumerate(corpus(3))] + [(500, prose(rnd, 30000)), (501, "ab" * 60000), (None, "x y"), (0, "again"), (0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("row", F.lit(2))
    library = Tokenizer.from_file(PATH)
    expected = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows)
    found = bpe.decode(bpe.encode(docs, PATH, leaf_chars=2000), PATH).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found) == expected
    digest = bpe.encode(docs, PATH).where("doc_id = 500").select(bpe.ids_digest(F.col("ids"))).first()[0]
    assert digest == hashlib.sha256(",".join(map(str, library.encode(rows[-5][1], add_special_tokens=False).ids)).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_decoded_where_it_is_encoded(spark):
    rows = [(0, prose(random.Random(5), 3000)), (1, "é" * 5000), (2, None), (3, "a <|endoftext|> b"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    apart, together = bpe.decode(bpe.encode(docs, PATH, leaf_chars=2000), PATH), bpe.encode(docs, PATH, leaf_chars=2000, decoded=True)
    assert (python_at_once(apart), python_at_once(together)) == (2, 1)
    assert together.schema == apart.schema
    plain = lambda df: Counter((r.doc_id, tuple(r.ids), r.decoded) for r in df.collect())
    assert plain(together) == plain(apart)
    assert {r.doc_id: r.decoded for r in together.collect()} == {i: t or "" for i, t in rows}


def plain_removal(rows, length=50):
    first = {}
    order = sorted(rows, key=lambda r: suffixes.LAST if r[0] is None else r[0])
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], suffixes.LAST if i is None else i)
    out = []
    for i, t in rows:
        b, rank = (t or "").encode(), suffixes.LAST if i is None else i
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < rank:
                gone[p : p + length] = True
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_strings(spark, seed):
    rnd = random.Random(seed)
    passage, run = prose(rnd, 30), "é" * 400
    texts_of_one = prose(rnd, 50)
    rows = [(i, t) for i, t, *_ in corpus(seed, 40)]
    rows += [(100 + k, prose(rnd, 20) + passage[k : k + rnd.randrange(40, 120)] + prose(rnd, 20)) for k in range(12)]
    rows += [(200, run), (201, run + "x"), (202, "=" * 49), (203, "=" * 49), (204, "=" * 50), (205, "=" * 51), (210, texts_of_one), (211, texts_of_one), (212, texts_of_one + "!"), (206, "ab" * 300), (207, "ba" * 300), (None, passage), (None, passage), (5, passage), (5, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("id", F.lit("y")).repartition(5)
    for size, hot in ((1_500_000, 1_500_000), (40, 8)):
        found = suffixes.remove_repeated_strings(docs, anchors_in_bucket=size, anchors_of_gram=hot, sampled=1).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == plain_removal(rows)
    assert suffixes.remove_repeated_strings(docs.limit(0)).count() == 0


def test_anchors_do_not_depend_on_pieces():
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.randrange(1, 300)).encode() for _ in range(20)] + [b"", b"x" * 700]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    whole, parts = suffixes.anchors(data, ends, 50), suffixes.anchors(data, ends, 50, piece=331)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_a_sentence_on_every_page(spark):
    """The anchors of frequent grams travel by the strings around them, in each of which edges differ."""
    rnd = random.Random(61)
    sentence = prose(rnd, 30)
    rows = [(i, prose(rnd, 8) + sentence + prose(rnd, 8) if i % 7 else prose(rnd, 20)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbered = docs.selectExpr("doc_id as row", "text")
    assert 0 < len(suffixes.frequent_grams(numbered, 50, 100, 1)) < 40
    found = suffixes.remove_repeated_strings(docs, anchors_of_gram=100, sampled=1).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == plain_removal(rows)


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "<|endoftext|>", "<\\|endoftext|>", "\\", "\\\\<|", "", None, "é日本😀", " trailing \n", "<turn user>", "|>", "<|" * 5]
    rows = [(1, k, role, t) for k, t in enumerate(nasty) for role in ("assistant",)] + [(2, 0, None, "x"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 1, "a\nb>", "t"), (3, None, "assistant", "last"), (3, 1, "assistant", "b" * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0)).withColumn("turns", F.lit(0))
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, PATH), PATH).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert found[conv].n_turns == len(own)
        assert found[conv].turns == "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        assert found[conv].loss_text == "".join(text for _, _, role, text in own if role == "assistant")
    assert chat.format_conversations(turns.limit(0), PATH).count() == 0


def test_masks_hold_the_tokens_of_the_spans():
    ends = np.array([2, 5, 9, 10, 14])
    assert chat.mask(ends, np.array([[2, 9], [9, 9], [10, 14]])).tolist() == [False, True, True, False, True]
    assert chat.mask(ends, np.zeros((0, 2), np.int64)).tolist() == [False] * 5


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- no <p>no</p> -->
<div class="cookie-notice">Accept</div><main><article><h1>Head &amp; line</h1><p><b>One&nbsp;two<br>three<p>Four
 five <i>si</i>x</p><div class="advert">Buy</div><ul><li>a<li>b</ul><section id="comments"><p>First!</p></section><form><input><p>Send</p></form></article></main><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Head & line One two three Four five six a b"),
        (None, ""), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>a<p>b</p></div>c", "a b c"), ("<p>x <script>if (a<b) {}</script>y</p>", "x y"), ("<!-- open <p>x", ""), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<body><div><p>kept</p></div><aside>side</aside><div hidden>h</div><div style='display: none'>n</div></body>", "kept"), ("<article>a</article><p>out</p><article>b</article>", "a b"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<article><header><h1>T</h1></header><p>x</article>", "T x"), ("<p>a</p><textarea><p>b</p></textarea>", "a"), ("<p>&amp;lt; &#233; &eacute</p>", "&lt; é é"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_templates_of_a_host_go(spark):
    rnd = random.Random(1)
    rows = [(i, f"http://{'a' if i % 2 else 'b'}.example/{i}", f"<div><p>Same on all</p></div><div><p>{prose(rnd, 20)}</p></div><div><p>{'on b' if i % 2 == 0 else prose(rnd, 3)}</p></div>") for i in range(30)]
    rows += [(90, None, "<p>no host</p>"), (91, "", None), (None, "http://a.example/x", "<p>Same on all</p>"), (92, "http://a.example/y", "x" * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("text", F.lit("z")).withColumn("_templates", F.lit("z"))
    found = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert len(found) == len(rows)
    assert not any("Same on all" in found[i] or "on b" in found[i] for i in range(30))
    assert all(len(found[i].split()) in ((20,) if i % 2 == 0 else (23,)) for i in range(30))
    assert (found[90], found[91], found[None], len(found[92])) == ("no host", "", "Same on all", 200000)
    assert extract_main_text(pages.limit(0)).count() == 0


def test_templates_inside_articles_go(spark):
    """Unlabelled blocks that recur inside articles go; the article, its inline words and headings, and copies stay."""
    rnd = random.Random(4)
    own = [prose(rnd, 40).replace("\n", " ") for _ in range(20)]
    inside = "<div><p>Read more of us</p><ul><li>one</li><li>two</li></ul></div>"
    rows = [(i, "http://a.example/x", f"<main><article class='post share'><h2>Summary</h2><p>{t} <b>the</b> end</p>{inside}<article class='comment'>Me first</article></article></main>") for i, t in enumerate(own)]
    rows += [(100 + i, "http://b.example/x", f"<article><p>{own[0]}</p><p>{own[1]}</p></article><p>{i}</p>") for i in range(8)]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Summary {t} the end" for i, t in enumerate(own)} | {100 + i: f"{own[0]} {own[1]}" for i in range(8)}


def plain_similarity(words, item, size=5):
    size = min(size, len(item))
    own = Counter(tuple(item[i : i + size]) for i in range(len(item) - size + 1))
    best, n = 0.0, len(item) - size + 1
    have = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    width = min(n, len(have))
    for s in range(len(have) - width + 1) if width else []:
        window = Counter(have[s : s + width])
        common = (window & own).total()
        best = max(best, common / (width + own.total() - common))
    return best


def test_contaminated(spark):
    rnd = random.Random(3)
    items = [prose(rnd, k) for k in (1, 3, 5, 20, 30, 30, 45, 45, 60)]
    items[7] = edited(rnd, items[6], 1)
    leaks = [prose(rnd, 40) + " " + edited(rnd, it, k).upper() + "! " + prose(rnd, 40) for it in items[3:] for k in (0, 0, 1, 1, 2, 3, 5)] + [items[6], items[8][: len(items[8]) // 2], items[5] + ". " + items[5]]
    rows = list(enumerate(leaks)) + [(i + 1000, t) for i, t, *_ in corpus(9)] + [(None, items[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("found", F.lit(0))
    benchmark = spark.createDataFrame([*enumerate(items), (70, None), (71, ""), (72, "..."), (None, items[3])], "item_id long, text string")
    expected = {}
    for d, t in rows:
        for i, item in enumerate(items):
            s = plain_similarity(words_of(t), words_of(item))
            if s >= 0.8:
                expected[d, i] = s
    found = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, benchmark).collect()}
    assert set(found) == set(expected)
    assert all(found[k] == pytest.approx(expected[k]) for k in found)
    again = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark, items_at_once=2).collect()}
    assert again == set(found)
    kept = decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in {k[0] for k in expected})
    assert decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    assert decontaminate(docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("at_once", [1, 20_000])
def test_clean_rows_stay_beside_rows_of_the_same_or_no_id(spark, at_once):
    rnd = random.Random(31)
    items = [prose(rnd, 30) for _ in range(3)]
    leaks = [prose(rnd, 20) + " " + item for item in items]
    rows = [(None, leaks[0]), (None, "clean one"), (None, None), (5, leaks[1]), (5, "clean two"), (6, leaks[2]), (7, "clean three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = decontaminate(docs, benchmark, items_at_once=at_once).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(str(r) for r in rows if r[1] not in leaks)


def test_lines(spark):
    rows = [(i, f" menu \nown {i}\nmenu\n\n", "en", "a", 1) for i in range(20)] + [(50 + i, f"menu\nother {i}", "en", "b", 1) for i in range(3)] + [(80 + i, "all of it", None, None, 1) for i in range(6)]
    rows += [(90, None, None, "a", None), (91, "", None, "a", 0), (92, "menu", None, "a", 4), (None, "x\r\ny", None, "c", 3)]
    docs = spark.createDataFrame(rows, DOC).withColumn("host", F.lit(1)).withColumn("n_lines", F.lit(-1)).withColumn("drop", F.lit(1)).withColumn("doc", F.lit(1))
    found = drop_boilerplate(docs)
    by_id = {r.doc_id: r for r in found.collect()}
    assert found.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert by_id[3].text == "own 3\n\n"
    assert (by_id[3].n_lines, by_id[3].n_dropped) == (5, 2)
    assert by_id[51].text == "menu\nother 1"
    assert by_id[81].text == ""
    assert (by_id[90].text, by_id[91].text, by_id[92].text, by_id[None].text) == (None, "", "", "x\r\ny")
    assert drop_boilerplate(docs.limit(0)).count() == 0


LANGUAGES = {"xx": ["ba", "do", "ki", "lu"], "yy": ["sch", "ei", "ung", "öt"], "zz": ["tion", "é", "eau", "ou"]}


def test_languages(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randrange(1, 60), LANGUAGES[lang]), lang) for i in range(360) for lang in [rnd.choice("xyz") * 2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = [(1000 + i, prose(rnd, 8, LANGUAGES[lang]), lang) for i in range(90) for lang in [rnd.choice("xyz") * 2]] + [(2000, None, None), (2001, "", None), (2002, "123 !! \n", None), (2003, prose(rnd, 40000, LANGUAGES["yy"]), "yy"), (2004, "ЖЩЮ ЖЪЫ ЩЩЪ " * 30, None)]
    model = fit_languages(docs, clusters=3)
    asked = spark.createDataFrame(test, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("x"))
    found = {r.doc_id: r for r in identify_languages(asked, model).collect()}
    right = sum(found[i].lang_pred == lang for i, _, lang in test if lang)
    assert right >= 0.97 * 91
    assert all((found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True) for i in (2000, 2001, 2002))
    assert found[2004].rejected
    assert sum(found[i].rejected for i, _, lang in test if lang) == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    empty = fit_languages(docs.limit(0))
    assert {(r.lang_pred, r.rejected) for r in identify_languages(asked, empty).collect()} == {("und", True)}
    assert identify_languages(asked.limit(0), model).count() == 0


def test_quality(spark):
    rnd = random.Random(6)

    def junk(t):
        return rnd.choice([t.upper().replace(" ", "!! "), t.replace(" ", "*** "), " ".join(w for w in t.split() for _ in (0, 1)), t.replace(" ", " | ")])

    rows = [(i, prose(rnd, 60) if i % 3 else junk(prose(rnd, 60)), int(i % 3 > 0)) for i in range(500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 350] + [(None, 1), (3, None), (7777, 0), (5, rows[5][2])], "doc_id long, quality int")
    model = fit_quality(docs.where("doc_id < 350"), labels)
    asked = docs.union(spark.createDataFrame([(900, None), (901, " "), (902, prose(rnd, 30000)), (None, prose(rnd, 50))], docs.schema)).withColumn("score", F.lit(0))
    found = {r.doc_id: r.score for r in score_quality(asked, model).collect()}
    right = sum((found[i] >= 0.7) == (y == 1) for i, _, y in rows if i >= 350)
    assert right >= 0.97 * 150
    assert found[900] == found[901] == pytest.approx(model.prior)
    assert all(0 <= s <= 1 for s in found.values())
    nothing = fit_quality(docs.limit(0), labels.limit(0))
    assert {r.score for r in score_quality(asked, nothing).collect()} == {0.5}
    assert score_quality(asked.limit(0), model).count() == 0


def test_scripts_without_blanks(spark):
    """An item in Chinese is found inside of a paragraph, whatever marks stand around it."""
    rnd = random.Random(41)
    signs = [chr(0x4E00 + k) for k in range(300)]
    item = "".join(rnd.choices(signs, k=40))
    around = ["".join(rnd.choices(signs, k=60)) for _ in range(2)]
    one_less = item[:20] + item[21:]
    rows = [(0, around[0] + item + around[1]), (1, f"{around[0]}。{item}、{around[1]}"), (2, around[0] + around[1]), (3, item[:15]), (4, around[0] + item[1:] + around[1]), (5, around[0] + one_less)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    expected = {d for d, t in rows if plain_similarity(words_of(t), words_of(item)) >= 0.8}
    assert {r.doc_id for r in found} == expected == {0, 1, 4}
    assert {r.similarity for r in found if r.doc_id < 4} == {1.0}


def test_long_and_repeated_texts_hold_items(spark):
    rnd = random.Random(42)
    items = [prose(rnd, k) for k in (7, 25, 61, 400)]
    long = " ".join([prose(rnd, 9000), items[2], prose(rnd, 4090), items[3], prose(rnd, 20), items[1]])
    rows = [(0, long), (1, long), (2, items[0]), (3, " ".join([items[0]] * 300)), (4, prose(rnd, 6000))]
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in found) == sorted([(d, i, 1.0) for d in (0, 1) for i in (1, 2, 3)] + [(2, 0, 1.0), (3, 0, 1.0)])
    assert {(r.doc_id, r.item_id): r.first_word for r in found}[3, 0] == 0


def test_fingerprints_within_the_radius_are_all_found():
    """The blocks point out every pair within the radius, by brute force over fingerprints with changed bits."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    t = decontaminate_module._tables(base, list(range(40)), [0] * 40, 11)
    for changed in range(15):
        prints = base.copy()
        for k in range(40):
            for bit in rng.choice(64, changed, replace=False).tolist():
                prints[k] ^= np.uint64(1 << bit)
        found = {(row, k): d for row, k, d in decontaminate_module._near(prints, decontaminate_module._blocks(prints), t, 11)}
        apart = np.bitwise_count(prints[:, None] ^ base)
        assert found == {(i, j): int(apart[i, j]) for i, j in zip(*np.nonzero(apart <= 11), strict=True)}


def test_windows_have_the_fingerprint_of_their_own_features():
    rng = np.random.default_rng(9)
    features = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    for width, prints in decontaminate_module.fingerprints(features, [1, 2, 13, 50, 255, 256, 300, 800]):
        for at in (0, 5, len(features) - width):
            ones = ((features[at : at + width, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
            assert int(prints[at]) == sum(1 << k for k in np.flatnonzero(2 * ones > width).tolist())


def test_edited_items_are_found():
    """Recall of windows with edits at either edge or inside, of those that reach the similarity."""
    rnd = random.Random(43)
    items = tuple((i, prose(rnd, rnd.randrange(14, 60))) for i in range(60))
    index = decontaminate_module.build_index(items, 5, 11)
    wanted = found = 0
    for i, item in items:
        for kind in range(6):
            words, k = item.split(), rnd.randrange(1, 6)
            new = prose(rnd, k).split()
            words = [words, [*words[:-k], *new], [*new, *words[k:]], [*words[: len(words) // 2], "x", *words[len(words) // 2 :]], words[k:], words[:-1]][kind]
            text = " ".join([prose(rnd, 30), *words, prose(rnd, 30)])
            s = plain_similarity(words_of(text), words_of(item))
            if s >= 0.8:
                wanted += 1
                found += any(m[0] == i and m[1] == pytest.approx(s) for m in next(decontaminate_module.matches([text], index, 5, 11, 0.8)))
    assert wanted > 200 and found >= 0.99 * wanted


def test_templates_by_brute_force(spark):
    """Generated pages: blocks drawn from a pool of the host, inside and outside of an article, against counts by hand."""
    rnd = random.Random(51)
    rows, plain = [], []
    for host in range(3):
        pool = [prose(rnd, 6).replace("\n", " ") for _ in range(6)]
        for k in range(30):
            inside = [(prose(rnd, 40).replace("\n", " "), "p") for _ in range(3)] + [(t, "section") for t in rnd.sample(pool[1:], 2) + pool[:1] * (k % 5 > 0)]
            inside += [(t, "aside-note") for t in rnd.sample(pool, 1)]
            outside = [(t, "div") for t in rnd.sample(pool, 1)]
            rnd.shuffle(inside)
            tag = {"aside-note": 'div class="notice-board"'}
            html = "".join(f"<div>{t}</div>" for t, _ in outside) + "<article>" + "".join(f"<{tag.get(e, e)}>{t}</{tag.get(e, e).split()[0]}>" for t, e in inside) + "</article>"
            rows.append((len(rows), f"https://h{host}.example/{k}", html))
            plain.append((host, [("div" if e == "aside-note" else e, t) for t, e in inside], [(e, t) for t, e in outside]))
    # a subtree is its element and text, wherever it stands; in an article it must be on most pages, unless in doubt (div)
    pages = Counter((host, block) for host, inside, outside in plain for block in {*inside, *outside})
    often = {key for key, n in pages.items() if n >= 5 and (n >= 0.2 * 30 if key[1][0] == "div" else n > 0.5 * 30)}
    assert sum(e == "section" for _, (e, _) in often) == 3 and sum(e == "div" for _, (e, _) in often) > 6
    assert sum(n >= 6 for key, n in pages.items() if key[1][0] == "section") > 10
    plain = [(host, inside) for host, inside, _ in plain]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: " ".join(t for e, t in blocks if (host, (e, t)) not in often) for i, (host, blocks) in enumerate(plain)}
    assert sum(found[i] != main_text(r[2]) for i, r in enumerate(rows)) > 0.9 * len(rows)  # almost all have some template


def test_prose_on_some_pages_stays(spark):
    """A paragraph on 5 of 24 pages of a host is prose; one on 20 of them is a template."""
    page = lambda k: f"<article><p>Own text {k} of this page, and more of it.</p>{'<p>A passage on some pages.</p>' * (k < 5)}{'<p>Read our terms.</p>' * (k < 20)}</article>"
    rows = [(k, f"http://blog.example/{k}", page(k)) for k in range(24)]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"Own text {k} of this page, and more of it." + " A passage on some pages." * (k < 5) for k in range(24)}


BROKEN = {
    '<article><div class="social-history"><p>Chapter one. Chapter one.</p></div></article>': "Chapter one. Chapter one.",
    '<main><section class="comment-policy">One. Two. Three.</section></main>': "One. Two. Three.",
    '<article><p>a</p><p class="related">A sentence of the body.</p></article>': "a A sentence of the body.",
    '<article><div class="notice-board">One sentence.</div><div id="menu-history">Another one.</div></article>': "One sentence. Another one.",
    '<article><p>a</p><div class="related-posts">Read on</div><p class="ad"><a href="/x">Buy this</a></p></article>': "a",
    '<p>a</p><a href="foo>link y more</a><p>x</p>': "a link y more x",
    '<p>one</p><a href="foo>two</a> three <b class="x">four</b><p>five</p>': "one two three four five",
    'x <a href="foo>link y more': "x link y more",
    "<p title='it's'>don't</p> a < b and c > d <3 x": "don't a < b and c > d <3 x",
    '<img alt="a > b">t<i data-x="<b>y</b>">u</i>': "tu",
    "<form><p>the body of this page stands in one form</p><input name=q><button>Go</button></form>": "the body of this page stands in one form",
    "<article><h1>Title of it</h1><p>body text here</p><form><textarea></textarea>Leave a reply</form></article>": "Title of it body text here",
    "<p>a<!-- x --> b<!-- never ended <p>c": "a b",
    f'<main><section class="related-work"><p>{"Prior work. " * 30}</p></section><div class="related-posts">Read on</div></main>': ("Prior work. " * 30).strip(),
    f'<main><div class="social-history"><p>{"Chapter one. " * 30}</p></div><div class="share-buttons">Share</div></main>': ("Chapter one. " * 30).strip(),
    f'<main><p>body</p><div class="related-items-x">{"".join(f"<a href=/{k}>Some other page {k}</a>" for k in range(30))}</div></main>': "body",
}


@pytest.mark.parametrize("page", BROKEN)
def test_broken_markup_loses_no_text(page):
    assert main_text(page) == BROKEN[page]


@pytest.mark.parametrize("unit", ['<a "', '<a "x>y ', "<div>", "<div></span>", "<", "<!--", "< a", "<ul><li>a", "<p><b>x"])
def test_hostile_pages_take_time_in_proportion(unit):
    def seconds(n):
        start = time.process_time()
        main_text(unit * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 0.05 + 12 * max(seconds(10_000), 0.01)


def test_repeated_pages_and_many_of_one_host(spark):
    page = "<nav>menu</nav><article><p>the same page</p></article>"
    rows = [(1, "http://a.example/1", page)] * 7 + [(2, None, page), (3, "", None), (None, "http://a.example/2", "")]
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in found) == sorted([(1, "the same page")] * 7 + [(2, "the same page"), (3, ""), (0, "")])


@pytest.mark.parametrize("limit", ["64m", "64MB", "4096", None])
def test_any_notation_of_the_byte_limit(spark, limit):
    """A limit that the session names is left alone, and batches are cut where they arrive."""
    from visgauge.llm.common import in_arrow

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key) if limit is None else spark.conf.set(key, limit)
    try:
        sizes = in_arrow(spark.range(0, 20_000, 1, 1), lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n bigint", batch_bytes=8000)
        found = [r.n for r in sizes.collect()]
        assert sum(found) == 20_000 and max(found) <= 1024
        assert spark.conf.get(key) == (limit or "8000")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
