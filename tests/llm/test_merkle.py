"""The Merkle manifest against a plain reading of its definition."""

import hashlib
import random
import zlib

import pytest

from prismal.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def build(nodes, arity):
    """The top of a list of digests, and the siblings of each, before and after, level by level."""
    steps, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(place):
            run = level[p // arity * arity : p // arity * arity + arity]
            steps[i].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
            place[i] = p // arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], steps


def plain(rows, arity):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    leaves = []
    for r in rows:
        i, source, lang, n, text = r
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        changed = (i, source, lang, n, text.translate(lower) if text is not None and tampered else text)
        leaves.append((source, i, h(*map(field, r)), h(*map(field, changed))))
    leaves.sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2]))
    names = list(dict.fromkeys(x[0] for x in leaves))
    subs = {s: build([x[2] for x in leaves if x[0] == s], arity) for s in names}
    root, above = build([subs[s][0] for s in names], arity) if names else (None, [])
    out = []
    for k, s in enumerate(names):
        for x, steps in zip([x for x in leaves if x[0] == s], subs[s][1]):
            steps = steps + above[k]
            node = x[3]
            for before, after in steps:
                node = h(before, node, after)
            out.append((x[1], x[2], subs[s][0], root, h(*(b + a for b, a in steps)), node, node == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place int, hash string"


@pytest.mark.parametrize("arity", [2, 16])
def test_manifest_equals_plain_trees(spark, arity):
    rng = random.Random(arity)
    sources = ["hot"] * 5 + ["a", "é", "Z", None]
    rows = [(rng.randrange(10**6), rng.choice(sources), rng.choice(["en", None]), rng.randrange(99), "Text Émile %d" % i) for i in range(700)]
    rows += [(1, "lone", "en", 3, "AbC"), (None, "a", None, None, None), (7, "a", "en", 0, ""), (7, "a", "en", 0, ""), (7, "a", "en", 0, None),
             (9, None, "en", 5, "X" * 300_000)]
    rows += [(i, f"many{i % 40}", "en", 1, "T") for i in range(80)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r)[:7] for r in merkle.manifest(df, arity=arity).collect()]
    assert sorted(got, key=repr) == plain(rows, arity)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_manifest_of_few_and_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(4, "a", "en", 2, "Hi")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = [tuple(r)[:7] for r in merkle.manifest(df).collect()]
    assert got == plain(rows, 16) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")
