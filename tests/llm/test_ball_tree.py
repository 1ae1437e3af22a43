"""Ranked search against scoring every document for every item."""

import collections
import math
import random
import re

import numpy as np
import pytest

from prismal.llm import ball_tree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in held:
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(4000)] + ["Été", "ÉTÉ", "ünï", "x-y", "日本", "under_score", "É9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 80)))) for i in range(500)]
    docs += [(500 + i, docs[7][1]) for i in range(60)]  # ties
    docs += [(600, None), (601, ""), (602, " .,_ "), (603, " ".join(rng.choices(words, k=30_000))), (604, "W1 w1\tW1."), (605, "Ete\x7fete")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(30)]
    items += [(40, None), (41, "..."), (42, docs[7][1]), (43, "never seen"), (44, "W1")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"per_block": 7, "terms_per_block": 60, "per_tree": 50, "leaf": 4}])
def test_ranks_equal_scoring_everything(spark, options):
    docs, items = corpus(5)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, term string").repartition(4)
    q = spark.createDataFrame([(i, t, 2) for i, t in items + items[:2]] + [(None, "w1", 2)], "item_id long, text string, score int")
    got = sorted(tuple(r) for r in ball_tree.rank(d, q, k=20, **options).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain(docs, items, 20)


def test_bounds_hold_and_prune():
    """No document of a node scores above its bound, and on grouped documents most leaves are passed over."""
    rng = np.random.default_rng(2)
    words, per = 400, 12
    rows = [np.unique(rng.integers(g * 20, g * 20 + 20, per)) for g in rng.integers(0, 20, 3000)]
    starts = np.cumsum([0] + [len(r) for r in rows])[:-1]
    flat = np.concatenate(rows)
    values = rng.integers(1, 10**9, len(flat))
    asked = [np.arange(g * 20, g * 20 + 8) for g in range(20)]
    queries = ball_tree.Queries(np.arange(20), np.arange(20) * 8, np.concatenate(asked), np.arange(words, dtype=np.uint64))
    tree = ball_tree.BallTree(starts, flat, values, queries, 16)
    for node, docs in enumerate(tree.members):
        at, begin = tree.entries(docs)
        for q in range(20):
            assert np.add.reduceat(np.where(np.isin(flat[at], asked[q]), values[at], 0), begin).max() <= tree.bounds[node][q]
    visited = []
    best = ball_tree.Best(20, 5)
    offer = best.offer
    best.offer = lambda q, s, i: (visited.append(q), offer(q, s, i))
    for q in range(20):
        tree.search(q, best, np.arange(3000))
    leaves = sum(c is None for c in tree.children)
    assert len(visited) < 20 * leaves / 2


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ball_tree.rank(none, items).count() == 0
    assert ball_tree.rank(none.limit(0), items.limit(0)).count() == 0
    assert ball_tree.rank(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).collect()[0]["doc_id"] == 1
