"""Operators that link documents or vectors."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import DOC, components, corpus, edited, groups, prose
from visgauge.llm import shared, simhash
from visgauge.llm.components import connected_components
from visgauge.llm.embeddings import embedding_links, embedding_near_duplicates


def plain_fingerprint(text, words=4):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@pytest.mark.parametrize("text", [None, "", " \n\t ", "One", "a b c d", "a b c d e", "É é\x0bx\x1fy z", "w " * 500, " not a blank here it is"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_is_that_of_the_sql_hash(spark):
    h = spark.sql("select xxhash64('a b c d') as h").first().h
    assert simhash.fingerprint("A b\tC d") == h & (2**64 - 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_components(spark, seed):
    rows = [*corpus(seed), (7, "one more row of id seven", None, None, 1), (None, "one", None, None, 3), (99, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumn("fp", F.lit(1)).withColumn("id", F.lit("x")).withColumn("component_id", F.lit(0))
    prints = [plain_fingerprint(r[1]) for r in rows]
    of = components(set(prints), [(a, b) for a, b in itertools.combinations(set(prints), 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[of[p]] = min(r[0], least.get(of[p], r[0]))
    expected = sorted((r[0] if r[0] is not None else -1, f"{p:016x}", least.get(of[p])) for r, p in zip(rows, prints, strict=True))
    found = simhash.simhash_components(docs).select(F.coalesce("doc_id", F.lit(-1)), F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted(map(tuple, found)) == expected


@pytest.mark.parametrize("block", [8, 5000])
def test_no_link_is_lost_in_large_cells(spark, block):
    """Fingerprints around one centre fill single cells, which are cut into blocks, and random ones lie beside them."""
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)}
    links = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 4]
    signed = lambda v: v - 2**64 if v >> 63 else v
    rows = spark.createDataFrame([(0, signed(v), signed(v)) for v in values], "tbl int, node long, fp long")
    found = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.link_fingerprints(rows, block_rows=block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert groups(components(values, found)) == groups(components(values, links))


def jaccard(a, b, words=5):
    sets = []
    for text in (a, b):
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_of_each(spark):
    rnd = random.Random(8)
    base = [prose(rnd, 200) for _ in range(12)]
    texts = base + [edited(rnd, t, k) for t in base[:6] for k in (0, 1, 2, 3, 6, 12)] + [t.replace(" ", "  ").upper() for t in base[:3]] + [None, "", " ", "x", "y"]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "row") for i, t in enumerate(texts)], "doc_id long, text string, _row string")
    of = components(range(len(texts)), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8])
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(of.values()))


def kept_of(texts):
    of = components(range(len(texts)), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8])
    return sorted(set(of.values()))


def test_copies_of_one_original_that_are_unlike_each_other(spark):
    """Each copy has one run of words that is its own: J with the original is above 0.8, and with the other copies below."""
    rnd = random.Random(21)
    words = prose(rnd, 230).split()
    texts = [" ".join(words)]
    for _ in range(250):
        at = rnd.randrange(len(words) - 18)
        texts.append(" ".join([*words[:at], *prose(rnd, 18).split(), *words[at + 18 :]]))
    rnd.shuffle(texts)
    expected = kept_of(texts)
    alone = [jaccard(a, b) >= 0.8 for a, b in itertools.combinations(texts, 2)]
    assert sum(alone) < 0.2 * len(alone) and len(expected) < 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == expected


@pytest.mark.parametrize("block", [6, 1024])
def test_lists_cut_into_blocks_give_all_pairs(spark, block, monkeypatch):
    """Without links made before, prefix filtering alone gives every pair of the similarity."""
    rnd = random.Random(23)
    base = [prose(rnd, k) for k in (3, 7, 12, 150, 300)]
    texts = sorted({edited(rnd, t, k % 3) for t in base for k in range(20)})
    pairs = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8}
    frequent = shared._frequent
    monkeypatch.setattr(shared, "_frequent", lambda texts, words: frequent(texts, words, one_of=1, least=2))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    found = {tuple(r) for r in shared.sharing_pairs(rows, spark.createDataFrame([], "node long, root long"), 5, 0.8, block).collect()}
    assert len(pairs) > 100 and pairs <= found


def test_candidates_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    """Of 240 copies of one text with a word or two changed, the most compared pairs are those below the similarity."""
    rnd = random.Random(5)
    base = prose(rnd, 120)
    texts = [edited(rnd, base, 1 + i % 3) for i in range(240)]
    asked, verified = [], simhash._verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    assert {r.doc_id for r in simhash.keep_one_of_each(frame).collect()} == set(components(range(len(texts)), links).values())
    assert sum(asked) < 20 * len(texts)


@pytest.mark.parametrize("how", ["appended", "prepended", "replaced"])
def test_near_copies_with_a_block_of_new_words(spark, how):
    rnd = random.Random(22)
    texts = []
    for k in range(40):
        words, share = prose(rnd, 200).split(), rnd.uniform(0.05, 0.1 if how == "replaced" else 0.25)
        new = prose(rnd, round(share * 200)).split()
        at = rnd.randrange(len(words) - len(new))
        texts += [" ".join(words), " ".join({"appended": words + new, "prepended": new + words, "replaced": words[:at] + new + words[at + len(new) :]}[how])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = kept_of(texts)
    assert len(expected) < 60
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == expected


def test_repeated_and_null_ids_keep_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "d"), (2, "e")], "doc_id long, text string")
    assert sorted(map(str, simhash.keep_one_of_each(docs).collect())) == sorted(map(str, docs.where("text in ('d', 'e')").union(docs.where("doc_id = 1").limit(1)).collect()))
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_connected_components(spark, seed):
    rnd = random.Random(seed)
    nodes = rnd.sample(range(-1000, 1000), 200)
    links = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(160)] + [(i, i + 1) for i in range(2000, 2060)] + [(5000, 5000 + i) for i in range(1, 80)] * 2
    links = [p for p in links if p[0] != p[1]]
    expected = components({n for p in links for n in p}, links)
    rows = spark.createDataFrame([*links, (None, 3), (4, None), (7, 7)], "a long, b long").repartition(5)
    assert {r.node: r.root for r in connected_components(rows).collect()} == expected
    assert {r.node: r.root for r in connected_components(rows, hot_links=3).collect()} == expected


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 64))
    near = base[rng.integers(0, 40, 120)] + rng.standard_normal((120, 64)) * rng.choice([0.02, 0.1, 0.15, 0.2, 0.3], (120, 1))
    x = np.vstack([base, near, base[:10], np.zeros((1, 64))])
    labels = [int(v) if v < 3 else None for v in rng.integers(0, 4, len(x))]
    rows = [(i, v.tolist(), label, "x") for i, (v, label) in enumerate(zip(x, labels, strict=True))]
    rows += [(900, None, 1, "x"), (901, [], 1, "x"), (902, [float("nan")] * 64, 1, "x"), (903, [float("inf")] + [0.0] * 63, 1, "x"), (904, [None] + [1.0] * 63, 1, "x"), (905, [1.0, 2.0], 1, "x"), (906, [2.0, 4.0], 1, "x"), (None, base[0].tolist(), 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid string")
    good = {i: (np.array(v), label) for i, v, label, _ in rows if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and cosine(good[a][0], good[b][0]) >= 0.98]
    of = components([r[0] for r in rows if r[0] is not None], links)
    n = {i: sum(i in p for p in links) for i in of}
    found = embedding_near_duplicates(frame).collect()
    assert len(found) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found if r.vec_id is not None} == {i: (n[i], of[i], of[i] == i) for i in of}
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, False)]
    assert embedding_near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 1024])
def test_embedding_links_of_a_hot_bucket_count_once(spark, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, 1 + i % 3, (base + rng.standard_normal(16) * 0.05).tolist(), 1) for i in range(90)]
    frame = spark.createDataFrame(rows, "cid long, m long, embedding array<double>, label long")
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = {(a, b) for a, b in itertools.combinations(range(90), 2) if x[a] @ x[b] >= 0.98}
    found = embedding_links(frame, block_rows=block).collect()
    counts = Counter()
    for r in found:
        counts[r.u] += r.n
    assert {k: n for k, n in counts.items() if n} == {i: n for i in range(90) if (n := sum(rows[b if a == i else a][1] for a, b in expected if i in (a, b)))}
    joined = [(r.u, r.v) for r in found if r.v is not None]
    assert components(range(90), joined) == components(range(90), expected)
    assert len(joined) < 40 * 90


def test_labels_of_any_type_ties_and_copies(spark):
    """Text labels, a cosine of exactly the threshold, -0.0 beside 0.0, and a vector with many copies."""
    rows = [(i, [1.0, 0.0], "a") for i in range(40)] + [(40, [1.0, -0.0], "a"), (41, [0.6, 0.8], "a"), (42, [0.6, 0.8], "b"), (43, [2.0, 0.0], "b")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_duplicates(frame, hot_copies=5).collect()}
    assert found == {i: (40, 0) for i in range(41)} | {41: (0, 41), 42: (0, 42), 43: (0, 43)}
    tied = spark.createDataFrame([(1, [3.0, 4.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in embedding_near_duplicates(tied, threshold=0.6, bits=1).collect()} == {1: 2, 2: 1, 3: 1}


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components_of_few_links_take_few_tasks(spark, shape):
    """With 48 shuffle partitions that are all kept, rounds of joins took 2,311 to 6,209 tasks for each of these graphs."""
    rnd = random.Random(5)
    nodes = rnd.sample(range(-1000, 1000), 300)
    links = {"path": list(itertools.pairwise(nodes)), "star": [(nodes[7], x) for x in nodes], "random": [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(250)]}[shape]
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, x in held.items():
            spark.conf.set(k, x)
        rows = spark.createDataFrame(links, "a long, b long").repartition(48).localCheckpoint()
        context.setJobGroup(f"components-{shape}", "")
        found = [(r.node, r.root) for r in connected_components(rows).collect()]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, x in before.items():
            spark.conf.set(k, x)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert len(found) == len(linked) and dict(found) == components(linked, links)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(f"components-{shape}") for s in tracker.getJobInfo(j).stageIds}
    assert 0 < sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 800
