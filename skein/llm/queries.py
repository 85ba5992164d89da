"""One query for each operator, over its whole table, with production parameters; and their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, embed, langid, licenses, lm, minhash, mixing, quality, toxicity, warc

#: Where the tokenizer's vocabulary is; see tokenizer_path().
VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(table(spark, sf_dir, "embeddings"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op1_mixing: all but the words taken."""
    return op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op5_quality: all but the verdict."""
    return op5_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict:
    return {f.__name__: f for f in (mixing_targets, quality_measures, op1_mixing, op2_minhash, op3_language, op4_toxicity, op5_quality, op6_licenses, op7_lm, op8_warc, op9_bpe, op10_embeddings)}


#: Brute force over all pairs; the operators find these pairs without meeting all.
SQL = {
    "op2_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.b FROM r JOIN both_ways t ON t.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
""",
    "mixing_targets": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
r AS (  -- the sources that are not full yet, and what they share
  SELECT 0 AS step, list({'source': source, 'size': size, 'w': w} ORDER BY source NULLS LAST) AS l, 1.5 * sum(size)::DOUBLE AS rest FROM s
  UNION ALL SELECT step + 1, list_filter(l, lambda x: x.w * rest / t < 2.0 * x.size), rest - list_sum(list_transform(list_filter(l, lambda x: x.w * rest / t >= 2.0 * x.size), lambda x: 2.0 * x.size))
  FROM (SELECT *, list_sum(list_transform(l, lambda x: x.w)) AS t FROM r) WHERE len(list_filter(l, lambda x: x.w * rest / t >= 2.0 * x.size)) > 0
), z AS (SELECT * FROM r ORDER BY step DESC LIMIT 1),
o AS (SELECT u.x.source AS source, u.x.w * u.rest / u.t AS target FROM (SELECT unnest(l) AS x, rest, list_sum(list_transform(l, lambda x: x.w)) AS t FROM z) u)
SELECT d.doc_id, d.size, s.size AS source_size, round(coalesce(o.target, 2.0 * s.size), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN o ON o.source IS NOT DISTINCT FROM s.source
""",
    "quality_measures": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g FROM w WHERE len(w) >= 9),
n AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(g.i, g.i + 8)) AS p FROM g JOIN n ON n.r = g.r AND n.g = g.g) GROUP BY r),
x AS (SELECT d.doc_id, len(w.w) AS n_words, length(translate(d.t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(d.t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l, coalesce(c.n, 0) AS n_repeat_words FROM d JOIN w ON w.r = d.r LEFT JOIN c ON c.r = d.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x
""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h),
x AS (SELECT p.page_id, octet_length(encode(p.h)) AS n, sha1(p.h) AS d, g.m FROM p JOIN g ON p.h = g.h),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', d[i]) - 1), 4, '0')), 'string_agg', '') AS b FROM x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(b[i * 5 + k + 1] AS INT) * CAST(pow(2, 4 - k) AS INT))) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM bits
""",
    "op10_embeddings": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.m AS component_id, v.vec_id = c.m AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
}
