"""Small corpora and plain versions of the operators that their results are held against."""

from __future__ import annotations

import random
from collections import defaultdict

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["ba", "do", "ki", "lu", "me", "na", "po", "ri", "sa", "tu", "ve", "zo"]


def prose(rnd: random.Random, words: int, syllables: list[str] = SYLLABLES) -> str:
    out = ["".join(rnd.choices(syllables, k=rnd.randrange(1, 5))) for _ in range(words)]
    return "".join(w + ("\n" if rnd.random() < 0.08 else " ") for w in out).strip()


def edited(rnd: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = prose(rnd, 1)
    return " ".join(words)


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def groups(of: dict) -> set[frozenset]:
    out = defaultdict(set)
    for n, root in of.items():
        out[root].add(n)
    return {frozenset(g) for g in out.values()}


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Rows with exact and near copies, an empty and a null text, a one-word text and a long one."""
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randrange(1, 120)) for _ in range(n - 10)]
    texts += [texts[0], texts[1], edited(rnd, texts[2], 1), edited(rnd, texts[3], 2), texts[4] + " " + texts[5], "", None, "one", prose(rnd, 4000), texts[6].upper()]
    rnd.shuffle(texts)
    return [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]


def python_at_once(df) -> int:
    """The most Python functions that one task of the plan of df runs side by side, each in a worker of its own."""
    most = 0

    def own(plan) -> int:
        nonlocal most
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return own(plan.initialPlan())
        below = [own(plan.children().apply(i)) for i in range(plan.children().size())]
        if "Exchange" in name:
            return 0
        n = (max(below, default=0) if name == "Union" else sum(below)) + ("InArrow" in name)
        most = max(most, n)
        return n

    own(df._jdf.queryExecution().executedPlan())
    return most
