"""The corpus pipeline on a small fixture: the last stage's places against a mix scheduled in plain Python."""

import hashlib
import random
from fractions import Fraction

import corpus_pipeline


def plain_order(docs):
    """Ids of (id, source, size, order, tie) in the order of the mix: blocks of 200,000 by hash order, earliest deadline first against the ideal mix."""
    blocks, weights = {}, {}
    for s in sorted({d[1] for d in docs}):
        before, own = 0, {}
        for d in sorted((d for d in docs if d[1] == s), key=lambda d: d[3:]):
            own.setdefault(before // 200_000, []).append(d[0])
            before += d[2]
        blocks[s], weights[s] = [own[k] for k in sorted(own)], Fraction(before ** 0.5)

    def reached(s, j):  # when the ideal mix has dealt j blocks of s
        v = j / weights[s]
        return sum(min(len(b), weights[x] * v) for x, b in blocks.items())

    jobs = [(reached(s, j), reached(s, j + 1), s, j) for s, b in blocks.items() for j in range(len(b))]
    out = []
    for slot in range(len(jobs)):
        job = min((j for j in jobs if j[0] < slot + 1), key=lambda j: (-(-j[1] // 1), j[2]))
        jobs.remove(job)
        out += blocks[job[2]][job[3]]
    return out


def test_the_last_stage_returns_the_places_of_the_mix(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(60, 9000))), "en", rng.choice("aaaabbc"), 0) for i in range(120)]
    texts = {r[0]: r[1] for r in rows}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the mix is written in several files
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "decoded_sha256", "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(out) > 110 and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)
    kept = {r.doc_id for r in out}
    hashed = spark.createDataFrame([r for r in rows if r[0] in kept], "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "doc_id", "source", "length(text) + 1", "shiftrightunsigned(xxhash64(doc_id, text), 1)", "xxhash64(1, doc_id, text)")
    assert [r.place for r in sorted(out, key=lambda r: r.place)] == list(range(1, len(out) + 1))
    assert [r.doc_id for r in sorted(out, key=lambda r: r.place)] == plain_order([tuple(r) for r in hashed.collect()])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot long, _row string, text_a int, _ratio0 string, column int"


def odd_documents():
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abc"}
    text["long"] = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(20_000))
    rows = [(1, text["a"]), (2, text["a"]), (3, None), (4, ""), (5, text["long"]), (5, text["long"]), (None, text["b"]), (6, text["c"])]
    return [(i, t, None, None if i == 6 else "s", None, "x", 5, "y", 7, "z", 8) for i, t in rows]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, and more columns with names that the stages use."""
    rows = odd_documents()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert name == "byte_bpe" or found.columns == docs.columns
        out[name] = found.collect()
    ids = {name: sorted((r.doc_id or 0) for r in found) for name, found in out.items()}
    every = [0, 1, 2, 3, 4, 5, 5, 6]
    assert ids == {"quality_rules": [0, 1, 2, 5, 5, 6], "line_dedup": every, "near_dedup": [0, 1, 3, 5, 6], "mix_sources": every, "byte_bpe": every}
    texts = {r[0]: r[1] for r in rows}
    for name in ("quality_rules", "near_dedup", "mix_sources"):
        assert all(r.text == texts[r.doc_id] and (r.text_a, r._row, r._ratio0, r.column) == (7, "y", "z", 8) for r in out[name])
    lines = {r.doc_id: r for r in out["line_dedup"]}
    assert lines[2].text == lines[3].text == lines[4].text == "" and lines[2].n_chars == 0
    assert all(lines[i].text == texts[i] and lines[i].n_chars == len(texts[i]) for i in (1, 5, 6, None))
    assert sorted(r.place for r in out["byte_bpe"]) == list(range(1, 9))
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() and r.n_tokens == len(r.ids) for r in out["byte_bpe"])
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 2, 5, 6]  # 2 lost its only line


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
