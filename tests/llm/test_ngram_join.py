"""The shingle join against all pairs compared one by one."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from prismal.llm import ngram_join

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    """doc_id -> (size, component) of rows with unique ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for _ in range(6):  # chains of small steps whose far ends are not alike
        text = make(120)
        for _ in range(7):
            text = list(text)
            text[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(text))
    passage, base = make(60), make(150)
    texts += [" ".join(make(rng.randrange(5, 90)) + passage + make(rng.randrange(5, 40))) for _ in range(60)]  # a shared passage, not near
    for _ in range(90):  # variants of one text, some near each other, some only near the text itself or nothing
        text = list(base)
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(text))
    texts += [" ".join(base)] * 40 + [" ".join(base).upper(), "  ".join(base) + "\n"]
    for n in (6, 9, 14, 20, 29):  # similarities at and around the threshold
        text = make(n)
        texts += [" ".join(text), " ".join(text + make(1)), " ".join(text[:-1]), " ".join(text[1:])]
    texts += [None, "", " \n\t", "a b", "A  b", "a b c d e", "a b c d e f", "one", "Élan", "élan", " ".join(make(6000))]
    rng.shuffle(texts)
    return list(enumerate(texts))


SCHEMA = "doc_id long, text string, size long, node string, component_id int"


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df).collect()}
    assert got == plain(rows)


def test_blocks_find_what_leaders_miss(spark):
    """Every bucket's pairs but those with its leader come from blocks: the links of all pairs across blocks of two."""
    rng = random.Random(3)
    words = ["w%d" % i for i in range(500)]
    base = [rng.choice(words) for _ in range(80)]
    rows = []
    for i in range(30):
        text = list(base)
        for _ in range(rng.randrange(1, 3)):
            text[rng.randrange(80)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rest = ngram_join.sets(df, "doc_id", "text", 5, 4).select(F.col("doc_id").alias("id"), "size", "tokens")
    heads = ngram_join.prefixes(rest, 80)
    open_ = heads.select(F.explode("a").alias("token"), "id", F.col("id").alias("root"))
    sets = {i: shingle_set(t) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(range(30), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in ngram_join.links_of_blocks(open_, heads, rest, 80, per=2).collect()}
    assert got == want and len(want) > 20


def test_repeated_ids_null_ids_and_no_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(5, text), (5, "other words that are here alone"), (5, text), (3, text.upper()), (None, text), (None, None), (9, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(5, 26, 3), (5, 2, 5), (5, 26, 3), (3, 26, 3), (None, 26, None), (None, 0, None), (9, 0, 9)], key=repr)
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
