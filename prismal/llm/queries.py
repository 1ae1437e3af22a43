"""The query of each operator, over whole tables, and the SQL that must give the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.llm import ball_tree, bpe, line_dedup, merkle, mixing, near_dedup, ngram_join, pii, quality_rank, quality_rules, token_counts, token_files, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(bpe.round_trip(docs))


def bpe_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids to flat files and answers from the files."""
    return token_files.digests(token_files.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums for every encoded length of the corpus."""
    return token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"))))


# The set of characters to strip is written as chr() codes: space, tab, line feed, vertical tab, form feed, carriage return.
OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line FROM documents,
  LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) AS u),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.first IS NOT NULL AND k.doc_id <> h.first AS dropped
  FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops lines shared by documents from every text."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the forest's verdict for every document."""
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=lambda d: d.drop("text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query("op7_quality_rank")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by what preference pairs of labelled ones teach."""
    out = quality_rank.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=lambda d: d.drop("text"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query("op10_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_mix_sources")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mix whose sources weigh the square root of their size."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=lambda d: d.drop("text"))
    return out.select("doc_id", "source", "block", "slot", "place")


OP6_SQL = """
WITH exact AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM exact q JOIN exact c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op6_top_products", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    return topk.top_products(table(spark, sf_dir, "embeddings"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the base formats and what boosted trees add."""
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


# crc32 of the decimal doc_id is spelled out: DuckDB has none.
OP11_SQL = """
WITH RECURSIVE codes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
fields AS (
  SELECT doc_id, source, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS chosen,
         list_aggregate(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v) || ':' || v, '-')), 'string_agg', '') AS head
  FROM documents, codes),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN chosen THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS start
  FROM fields),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS src, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (ORDER BY encode(source) NULLS FIRST, doc_id NULLS FIRST, leaf) AS id
  FROM hashed WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
up AS (
  SELECT src, 0 AS level, place, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT src, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY src, level, place // 16, n),
subs AS (SELECT src, hash AS subroot, (SELECT count(*) FROM up WHERE n = 1) AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, src AS place, n, subroot AS hash FROM subs
  UNION ALL
  SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 16, n),
met AS (
  SELECT l.id, u.level AS step, u.place, u.hash, l.place >> (4 * u.level) AS own FROM leaves l
  JOIN up u ON u.src = l.src AND u.n > 1 AND u.place // 16 = l.place >> (4 * u.level + 4)
  UNION ALL
  SELECT l.id, 100 + t.level, t.place, t.hash, l.src >> (4 * t.level) FROM leaves l JOIN top t ON t.n > 1 AND t.place // 16 = l.src >> (4 * t.level + 4)),
steps AS (
  SELECT id, coalesce(string_agg(hash, '' ORDER BY place) FILTER (place < own), '') AS before, coalesce(string_agg(hash, '' ORDER BY place) FILTER (place > own), '') AS after,
         row_number() OVER (PARTITION BY id ORDER BY step) AS k FROM met GROUP BY id, step),
folded AS (
  SELECT id, 0::BIGINT AS k, start AS node FROM leaves
  UNION ALL
  SELECT f.id, s.k, sha256(s.before || f.node || s.after) FROM folded f JOIN steps s ON s.id = f.id AND s.k = f.k + 1),
ends AS (SELECT id, arg_max(node, k) AS folded_root FROM folded GROUP BY id),
proofs AS (SELECT id, string_agg(before || after, '' ORDER BY k) AS proof FROM steps GROUP BY id),
root AS (SELECT hash AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subs USING (src) JOIN ends USING (id) LEFT JOIN proofs USING (id) CROSS JOIN root"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and verdict under the trees of the sources and their root."""
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("steps")


OP12_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
held AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM split),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM held),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both_n
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * both_n >= 80 * (na + nb - both_n)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(b) FROM reached r WHERE r.a = held.doc_id) AS component_id FROM held"""


@query("op12_ngram_join", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of shingles and the class of every document under links of 80 %."""
    return ngram_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE len(w) > 0),
held AS (SELECT doc_id, d, len(w) AS n, unnest(w) AS term FROM words),
counted AS (SELECT doc_id, d, n, term, count(*) AS tf FROM held GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, total GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) CROSS JOIN total GROUP BY item_id, doc_id, d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    return ball_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
