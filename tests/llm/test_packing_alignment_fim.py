"""Packing, alignment and fill-in-the-middle, each against a plain version over whole texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import DOC, corpus, prose
from visgauge.llm import alignment, bpe, queries, rope
from visgauge.llm.fim import Marks, fill_in_middle, restore_texts
from visgauge.llm.packing import Packer, Piece, pack

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "b", "the", " ", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\r", ";\r\n", " ", "　", "\x85", "é", "日本", "😀", "\x00", "<|endoftext|>", "</s>", "<0x0A>", "'s", "123", "...", "\x0b", "{\r", "word", "Ġ", "\x1c"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choices([*SIGNS, "▁"], weights=[8] * len(SIGNS) + [1], k=rnd.randrange(30))) for _ in range(n)]


def documents(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOC).repartition(parts)


def stored(spark, tmp_path, texts, parts=3) -> str:
    documents(spark, texts, parts).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# ---- packing


@pytest.fixture(scope="module")
def tokens():
    return Tokenizer.from_file(A)


def plain_place(counts: Counter, size: int, length: int) -> int:
    """The level by trying each: the sum of squares over partly filled windows after the move, the fullest first."""
    best = None
    for h in [0, *sorted(counts)]:
        if h + size > length or (h and not counts[h]):
            continue
        after = counts.copy()
        if h:
            after[h] -= 1
        if h + size < length:
            after[h + size] += 1
        key = (sum(n * n for n in after.values()), -h)
        best = min(best or (key, h), (key, h))
    return best[1]


def test_the_rule_by_trying_all_levels():
    rnd = random.Random(4)
    packer, counts = Packer(32, 10**6), Counter()
    for k in range(600):
        size = rnd.choice([1, 3, 3, 7, 17, 20, 31, 32, rnd.randrange(1, 33)])
        level = plain_place(counts, size, 32)
        full = list(packer.place(Piece(k, 0, np.zeros(size, np.int32), size)))
        if level:
            counts[level] -= 1
        if level + size < 32:
            counts[level + size] += 1
        assert bool(full) == (level + size == 32)
        assert {h: n for h, n in enumerate(packer.counts) if n} == {h: n for h, n in counts.items() if n}
        assert [len(x) for x in packer.open] == packer.counts.tolist()


def check_pieces(rows, texts, tokens, length=2048):
    """rows of op11 against the contract; the sequences' lengths."""
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append(np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == want.keys()
    for doc_id, (ids, *others) in want.items():
        if others:  # repeated rows: pieces of either
            assert sum(r.length for r in by_doc[doc_id]) == len(ids) + sum(map(len, others))
            continue
        place = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (place, len(ids), zlib.crc32(ids[place : place + r.length].tobytes()))
            place += r.length
        assert place == len(ids)
    for pieces in by_sequence.values():
        place = 0
        for offset, n in sorted(pieces):
            assert offset == place and n > 0
            place += n
        assert place == length or (place < length and place & (place - 1) == 0)
    return [sum(n for _, n in p) for p in by_sequence.values()]


def test_packing_query(spark, tmp_path, tokens):
    rnd = random.Random(8)
    texts = [(i, t) for i, t, *_ in corpus(8, 200)] + [(1000, prose(rnd, 9000)), (1001, "x " * 50000), (1002, None), (1003, ""), (1003, ""), (None, "no id")]
    rows = queries.op11_packing(spark, stored(spark, tmp_path, texts)).collect()
    assert rows[0].__fields__ == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fills = check_pieces(rows, texts, tokens)
    assert sum(f < 2048 for f in fills) <= 11 * 4 + 11  # one rest of each task


def test_packing_cuts_few_documents(spark, tokens):
    rnd = random.Random(9)
    texts = [(i, prose(rnd, int(rnd.lognormvariate(4.5, 0.8)) + 1)) for i in range(3000)]
    rows = pack(bpe.encode(documents(spark, texts, 1), A), 1).selectExpr("explode(pieces) as p").select("p.*").collect()
    whole = [r for r in rows if r.length == r.doc_tokens]
    assert len(whole) > 0.9 * len(texts)


def test_packing_one_length_and_bounds(spark):
    docs = spark.createDataFrame([(k, [5] * 1099) for k in range(700)] + [(-1, None)], "doc_id long, ids array<int>").coalesce(1)
    rows = pack(docs, 2, most_open=50).collect()
    assert sum(len(r.ids) for r in rows) == 700 * 1100 + 1
    assert sorted({len(r.ids) for r in rows if len(r.ids) < 2048}) == sorted(1 << k for k in range(11) if (700 * 1100 + 1) % 2048 >> k & 1)
    assert all(r.ids[p.offset + p.length - 1] == 2 for r in rows for p in r.pieces if p.start + p.length == p.doc_tokens)
    assert pack(docs.limit(0), 2).collect() == []
    with pytest.raises(ValueError):
        pack(docs, 2, length=1000)


# ---- alignment


def plain_alignment(rows):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}

    def bytes_a(i):
        return bytes(byte_of[c] for c in tok.id_to_token(i))

    def bytes_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            a, b = [], []
        links, groups, i, j, end_a, end_b, first = [], [], 0, 0, 0, 0, (0, 0)
        while i < len(a):
            end_a, end_b = end_a or len(bytes_a(a[i])), end_b or len(bytes_b(b[j]))
            links.append((a[i], b[j]))
            step = (end_a <= end_b, end_b <= end_a)
            i, j = i + step[0], j + step[1]
            if all(step):
                groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
                first = (i, j)
            elif step[0]:
                end_a += len(bytes_a(a[i]))
            else:
                end_b += len(bytes_b(b[j]))
            if all(step) and i < len(a):
                end_a, end_b = end_a + len(bytes_a(a[i])), end_b + len(bytes_b(b[j]))
        docs.append((doc_id, a, b, links, groups))
    n = Counter(p for d in docs for p in set(d[3]))
    top = Counter()
    for (x, _), k in n.items():
        top[x] = max(top[x], k)
    rows = []
    for doc_id, a, b, links, groups in docs:
        text = ";".join(groups)
        rows.append((doc_id, len(a), len(b), len(groups), len(links), sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links), sha(text) if text else ""))
    return rows, n


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_alignment_query(spark, tmp_path):
    texts = list(enumerate(odd_texts(3, 1500)))
    texts += [(5000, None), (5001, ""), (5002, " "), (5003, "\n"), (5004, "x" * 200_000), (5005, " " * 50_000), (5006, "▁"), (5007, "a b"), (5007, "a b"), (None, "zz top"), (5008, "\n\na "), (5009, "é́" * 1000 + " " + "\t" * 3000)]
    found = queries.op12_token_alignment(spark, stored(spark, tmp_path, texts))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, _ = plain_alignment(texts)
    assert 50 < sum(r[1] == 0 for r in want) < 900
    assert order(map(tuple, found.collect())) == order(want)


def test_alignment_in_small_chunks_and_its_pairs(spark):
    texts = [(i, t) for i, t, *_ in corpus(12)] + list(enumerate(odd_texts(5, 100), 100))
    want, counts = plain_alignment(texts)
    for most_sent in (0, 10**6):  # pairs joined to the chunks, pairs sent to all tasks
        docs, pairs = alignment.align_tokenizers(documents(spark, texts), A, B, chunk_chars=500, buckets=7, most_sent=most_sent)
        assert order((*r[:-1], sha(r.groups) if r.groups else "") for r in docs.collect()) == order(want)
    rows = pairs.collect()
    assert {(r.a, r.b): r.n for r in rows} == dict(counts)
    top = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    assert all(r.best == (r.n == top[r.a]) for r in rows)


def test_alignment_of_nothing(spark):
    docs, pairs = alignment.align_tokenizers(documents(spark, [(1, "a")]).where("doc_id > 1"), A, B)
    assert docs.collect() == [] and pairs.collect() == []
    docs, pairs = alignment.align_tokenizers(documents(spark, [(1, None), (2, "▁ x")]), A, B)
    assert sorted(map(tuple, docs.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")] and pairs.collect() == []


def test_segments_tile_the_text():
    a, b = alignment.tokenizers(A, B)
    assert alignment.split_before(a, b) == " \n\t"
    pattern = alignment.segment_pattern(" \n\t")
    for text in odd_texts(6, 500):
        parts = pattern.findall(" " + text)
        assert "".join(parts) == " " + text
        assert [i for p in parts for i in a.encode(p).tolist()] == a.encode(" " + text).tolist()
    assert alignment.segment_pattern("\n").findall(" a b\nc") == [" a b\nc"]


# ---- fill-in-the-middle


def plain_fim(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digits = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:i], lines[i:j], lines[j:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_fill_in_middle_query(spark, tmp_path):
    rnd = random.Random(2)
    texts = list(enumerate("".join(rnd.choices(["a", "é", "😀", "\n", "\n", "<P", ">", "<", "S>", "\r\n", "word "], k=rnd.randrange(40))) for _ in range(400)))
    texts += [(900, None), (901, ""), (902, "\n"), (903, "x" * 100_000), (904, "line\n" * 30_000), (905, "has <M> in it"), (906, "a\nb"), (906, "a\nb"), (None, "one\ntwo\nthree"), (907, "\n\n\nend")]
    found = queries.op13_fill_in_middle(spark, stored(spark, tmp_path, texts))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [plain_fim(*t) for t in texts]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_small_leaves_other_marks_and_rates(spark):
    texts = list(enumerate(odd_texts(9, 300)))
    docs = documents(spark, texts)
    for percent, spm, marks in ((100, 0, Marks()), (40, 100, Marks("[pre]", "[suf]", "[mid]"))):
        rows = restore_texts(fill_in_middle(docs, percent=percent, spm_percent=spm, marks=marks, leaf_chars=3), marks, leaf_chars=5).collect()
        assert {r.doc_id: r.restored for r in rows} == dict(texts)
        assert {r.form for r in rows} == {"plain", "spm" if spm else "psm"}
        assert percent == 100 or 80 < sum(r.form != "plain" for r in rows) < 160
    assert fill_in_middle(docs.where("doc_id < 0")).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "xaby", "c"), ("aa", "b", "c"), ("<x", "x>", "|")):
        with pytest.raises(ValueError):
            Marks(*bad)


def test_ropes():
    rnd = random.Random(11)
    for _ in range(200):
        text = "".join(rnd.choices("ab\n", k=rnd.randrange(60)))
        tree = rope.build(text, rnd.randrange(1, 9))
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert rope.flat(tree) == text and rope.units(tree) == len(lines) and tree.chars == len(text)
        for k in range(len(lines) + 2):
            first, second = rope.split_units(tree, k)
            assert (rope.flat(first), rope.flat(second)) == ("".join(lines[:k]), "".join(lines[k:]))
            assert rope.units(first) + rope.units(second) == len(lines)
        for k in range(len(text) + 1):
            first, second = rope.split_chars(tree, k)
            assert (rope.flat(first), rope.flat(second), first.ends) == (text[:k], text[k:], text[:k].count("\n"))
    assert rope.build("x" * 100_000, 10).depth <= 14
