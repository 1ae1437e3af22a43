"""Operators over many documents or vectors against brute force, with hot groups and odd rows."""

import collections
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from prismal.llm import line_dedup, mixing, near_dedup, shingles, topk


def shingle_set(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_classes(texts, threshold=0.8):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        union = len(sets[a] | sets[b])
        if not union or len(sets[a] & sets[b]) >= threshold * union:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for _ in range(12):
        base = make(120)
        chain = list(base)
        for _ in range(8):  # a chain of small steps: far ends are less alike than the threshold
            chain = list(chain)
            chain[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(chain))
    template = make(100)
    texts += [" ".join(template[:70] + make(30)) for _ in range(40)]  # alike, but not near
    texts += [" ".join(template)] * 30 + [" ".join(make(60)) for _ in range(30)]
    texts += [None, "", " \n", "a b", "a  b", "a b c d e", "a b c d e f", "one", " ".join(make(4000))]
    return dict(enumerate(texts))


def test_near_duplicates_lose_no_link(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, class_id string")
    found = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert found == plain_classes(texts)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(found.values())


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.classes(df).collect() if r.doc_id) == [(2, 2), (4, 2), (4, 2), (7, 7)]
    assert sorted(str(r.doc_id) for r in near_dedup.keep_one(df).collect()) == ["2", "7", "None"]
    assert near_dedup.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_similarity(weighted):
    rng = np.random.default_rng(3)
    n, k = 400, 256
    shared_by_two, own = rng.integers(0, 2**63, (n // 2, 300)), rng.integers(0, 2**63, (n, 100))
    hashes = np.concatenate([np.repeat(shared_by_two, 2, axis=0), own], axis=1).astype(np.uint64).ravel()
    text = np.repeat(np.arange(n), 400)
    weights = np.tile(np.where(np.arange(400) < 300, 2 if weighted else 1, 1), n)
    signs = near_dedup.darts(hashes, text, weights, n, k)
    assert (signs != 0).all()
    shared, apart = weights[:300].sum(), weights[300:400].sum()
    agree = (signs[0::2] == signs[1::2]).mean()
    assert abs(agree - shared / (shared + 2 * apart)) < 0.01


def test_shingles_are_whole_and_distinct():
    texts = ["a b c d e a b c d e a b c d e", "", "a b", "a b c d e", "b c d e a"]
    data, ends = "".join(texts).encode(), np.cumsum([0] + [len(t) for t in texts])
    hashes, owner, counts = shingles.shingles(data, ends)
    assert np.bincount(owner, minlength=5).tolist() == [5, 0, 1, 1, 1]
    assert counts.sum() == 11 + 0 + 1 + 1 + 1
    assert hashes[owner == 3][0] in hashes[owner == 0] and hashes[owner == 4][0] in hashes[owner == 0]


def test_schedule_stays_within_a_block():
    rng = random.Random(6)
    for weights in ({"a": 1}, {"a": 1, "b": 1}, {"a": 1, "b": 1e-9, "c": 5}, {str(i): rng.random() ** 4 + 1e-6 for i in range(60)}):
        counts = mixing.frame_counts(weights, 500)
        order = mixing.schedule(counts)
        assert collections.Counter(order) == counts
        seen = collections.Counter()
        for t, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[x] - counts[x] * t / len(order)) < 1 for x in counts)


def ideal(blocks, weights, t):
    """What the ideal mix has given each source by slot t: all flow by weight, the others take over where one runs out."""
    left, given = {s: Fraction(n) for s, n in enumerate(blocks)}, [Fraction(0)] * len(blocks)
    while left and t > 0:
        total = sum(Fraction(weights[s]) for s in left)
        step = min([t] + [n * total / Fraction(weights[s]) for s, n in left.items()])
        for s in list(left):
            got = step * Fraction(weights[s]) / total
            given[s], left[s] = given[s] + got, left[s] - got
            if not left[s]:
                del left[s]
        t -= step
    return given


@pytest.mark.parametrize("weights,blocks", [([2 / 3, 1 / 3], [60_000, 30_000]), ([1.0, 0.0001], [30_000, 3]), ([0.1, 0.2, 0.7, 3e-5], [9000, 9000, 40_000, 40]),
                                            ([7, 5, 3, 3, 1, 1e-3], [500, 900, 40, 41, 300, 7])])
def test_slots_follow_the_target_weights_over_many_frames(weights, blocks):
    seen = [0] * len(blocks)
    total, first = sum(Fraction(w) for w in weights), min(n / Fraction(w) for n, w in zip(blocks, weights)) * sum(map(Fraction, weights))
    for t, (s, j) in enumerate(mixing.deal(blocks, mixing.whole(weights)), 1):
        assert j == seen[s]
        seen[s] += 1
        if t <= first and t % 7 == 0:
            assert all(abs(seen[x] - Fraction(w) * t / total) < 1 for x, w in enumerate(weights))
        elif t > first and t % 97 == 0:
            assert all(abs(a - b) < 1 for a, b in zip(seen, ideal(blocks, weights, t)))
    assert seen == blocks


def test_mix_follows_weights_that_a_frame_does_not_hold(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'b', 'a') AS source", "repeat('x', 99) AS text")
    out = mixing.mix(df, {"a": 2, "b": 1}, block_size=100, slots=1000).select("slot", "source").collect()
    order = [r.source for r in sorted(out, key=lambda r: r.slot)]
    seen = 0
    for t, s in enumerate(order, 1):
        seen += s == "b"
        assert abs(seen - t / 3) < 1


@pytest.mark.parametrize("weights", [None, {"hot": 1, "s1": 2, "*": 1}])
def test_mix_keeps_all_rows_and_its_weights(spark, weights):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["s1", "s2", None]), "x" * rng.randint(0, 300), "old") for i in range(3000)]
    rows += [(9000, "s1", None, "old"), (9001, "s1", "y" * 50_000, "old"), (None, "s2", "z", None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, slot string")
    out = mixing.mix(df, weights, block_size=5000, slots=100).collect()
    assert collections.Counter((r.doc_id, r.source, r.text) for r in out) == collections.Counter(r[:3] for r in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.slot].append(r)
    assert sorted(slots) == list(range(len(slots)))
    blocks = collections.defaultdict(list)
    for slot, own in sorted(slots.items()):
        assert len({r.block for r in own}) == 1 and sorted(r.place for r in own) == list(range(1, len(own) + 1))
        name = own[0].source if weights is None or own[0].source in weights else "*"
        blocks[name].append((slot, own[0].block))
    assert all([b for _, b in v] == list(range(len(v))) for v in blocks.values())
    if weights:  # until the first source runs out
        last = min(v[-1][0] for v in blocks.values())
        share = {"hot": 0.25, "s1": 0.5, "*": 0.25}
        assert all(abs(sum(slot <= last for slot, _ in v) - share[s] * (last + 1)) < 1 for s, v in blocks.items())
    assert mixing.mix(df.limit(0), weights).count() == 0
    assert [c for c in mixing.in_order(mixing.mix(df, weights)).columns if c != "slot"][:3] == ["doc_id", "source", "text"]


def test_every_source_of_many_has_its_own_share(spark):
    rng = random.Random(4)
    rows = [(i, "s%d" % (i % 1500), "x" * rng.randint(0, 20 if i % 1500 else 400)) for i in range(9000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_size=40, slots=500).select("doc_id", "source", "block", "slot").collect()
    assert sorted(r.doc_id for r in out) == list(range(9000))
    order = dict(sorted({r.slot: (r.source, r.block) for r in out}.items()))
    assert list(order) == list(range(len(order))) and len({(r.slot, r.source, r.block) for r in out}) == len(order)
    sizes, blocks = collections.Counter(), collections.Counter(s for s, _ in order.values())
    for _, s, t in rows:
        sizes[s] += len(t) + 1
    seen = collections.Counter()
    for slot, (s, block) in order.items():
        assert block == seen[s]
        seen[s] += 1
        if slot % 500 == 499:  # the ideal mix: every source at its rate until it runs out
            low, high = 0.0, float(len(order))
            for _ in range(200):
                v = (low + high) / 2
                low, high = (v, high) if sum(min(n, sizes[x] ** 0.5 * v) for x, n in blocks.items()) < slot + 1 else (low, v)
            assert all(abs(seen[x] - min(n, sizes[x] ** 0.5 * low)) < 1 + 1e-6 for x, n in blocks.items())


def plain_top(rows, k=5, every=50):
    exact = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in exact:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in exact if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("spread,per", [(0.0, 64), (1.5, 32), (3.0, 4096)])
def test_top_products(spark, spread, per):
    rng = np.random.default_rng(5)
    lengths = np.exp(spread * rng.normal(size=600))
    rows = [(i, [float(np.float32(x)) for x in lengths[i] * rng.normal(size=12)]) for i in range(600)]
    rows[7] = (7, rows[50][1])
    rows += [(1000 + i, [0.5] * 12) for i in range(200)] + [(2001, None), (2002, [float("nan")] + [1.0] * 11), (2003, [None] + [1.0] * 11), (None, [1.0] * 12),
                                                          (2004, [float("inf")] * 12), (2005, [9.0]), (2006, []), (2050, [0.0] * 12), rows[3]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(df, per_bucket=per, per_queries=8).collect()}
    assert found == plain_top(rows)
    assert topk.top_products(df.limit(0)).count() == 0


def test_query_blocks_meet_only_buckets_in_reach(spark):
    lengths = [90.0, 40.0, 40.0, 7.0, 0.0]
    needs = [float("-inf"), 0.0, 6.9999, 40.0, 41.0, 91.0, float("inf")]
    buckets = spark.createDataFrame(list(enumerate(lengths)), "bucket long, longest double")
    found = topk.meetings(spark.createDataFrame(list(enumerate(needs)), "qb long, need double"), buckets)
    assert sorted(map(tuple, found.collect())) == [(q, b) for q, need in enumerate(needs) for b in range(1, 5) if lengths[b] >= need]
    queries = np.array([[3.0, 4.0], [0.0, 0.0], [0.0, 0.0], [3.0, 4.0]])
    need = topk.needed_length(queries, np.array([50.0, 1.0, 0.0, -np.inf]))
    assert 9.99 < need[0] <= 10 and need[1] == np.inf and need[2] == need[3] == -np.inf


def test_top_products_of_great_numbers(spark):
    rows = [(0, [3e18, 1.0]), (1, [2e17, -5.0]), (2, [-2e17, 7.0]), (3, [float(2**30), 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.rank, r.vec_id): r.score for r in topk.top_products(df).collect()}
    assert found[(1, 1)] == 2**63 - 1 and found[(3, 2)] == -(2**63)


def test_texts_of_one_id_are_judged_each(spark):
    """A doc_id with several texts: none is lost, and none loses the lines of another."""
    long = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "xab"}
    df = spark.createDataFrame([(1, long["x"], "k"), (5, long["a"], "k"), (5, long["b"], "k"), (7, long["b"], "k"), (5, long["a"], "k")], "doc_id long, text string, _version string")
    kept = sorted((r.doc_id, r.text) for r in near_dedup.keep_one(df).collect())
    assert kept == [(1, long["x"]), (5, long["a"]), (5, long["b"])]
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.classes(df).collect()) == [(1, 1), (5, 5), (5, 5), (5, 5), (7, 5)]
    shared = "a line that is shared"
    rows = [(1, f"first\n{shared}"), (2, f"start of two\n{shared}"), (2, "another text line\nvaluable unique line here"), (2, None)]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, f"first\n{shared}"), (2, ""), (2, "another text line\nvaluable unique line here"), (2, "start of two")]
