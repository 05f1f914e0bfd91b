"""The queries opN_<name> of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_extract, langid, line_dedup, merkle, mixing, ngram_join, pii, sp_tokens, toxicity
from .common import crc_mod, load


#: The SentencePiece model that the queries encode with; a parameter of the operator.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    model = langid.train(docs, "text", "lang", ~F.col("held_out") & F.col("doc_id").isNotNull())
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "n_spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    model = toxicity.train_by_id(docs, learnable(spark, sf_dir))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned."""
    return load(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_groups(load(spark, sf_dir, "documents"), k=4, percent=85)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_tokens.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source")


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(merkle.with_next(load(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_ngram_join": op3_ngram_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_pii": op6_pii,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_mixing": op8_mixing,
    "op9_merkle": op9_merkle,
    "op10_toxicity": op10_toxicity,
}

_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [len(w) || ':' || array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: '4:' || array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pair WHERE 100 * c >= 85 * (na + nb - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM s
"""

_OP4 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
f AS (SELECT doc_id, p, line FROM l WHERE regexp_matches(line, '[^ \t\x0B\f\r]')),
w AS (SELECT doc_id, p, line, lead(p, 1) OVER d AS p2, lead(line, 1) OVER d AS line2, lead(p, 2) OVER d AS p3, lead(line, 2) OVER d AS line3 FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
again AS (SELECT * FROM w WHERE line3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([p, p2, p3]) AS p FROM again),
kept AS (SELECT l.doc_id, count(g.p) AS n, string_agg(CASE WHEN g.p IS NULL THEN line END, chr(10) ORDER BY l.p) AS text FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n, 0) AS n_lines_removed FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_OP8 = r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(doc_id || ':' || md5(coalesce(text, ''))) AS h FROM documents),
p0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM t GROUP BY source),
p1 AS (SELECT *, 1.0::DOUBLE + k % 3 AS w FROM p0),
p2 AS (SELECT *, sum(source_size) OVER () AS total, 3.0 * source_size / w AS cap, row_number() OVER (ORDER BY 3.0 * source_size / w, k) AS j FROM p1 WHERE source_size > 0),
p3 AS (SELECT *, (total - 3.0 * coalesce(sum(source_size) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p2),
lv AS (SELECT level FROM p3 WHERE level <= cap ORDER BY j LIMIT 1),
p4 AS (SELECT p1.k, p1.source, p1.source_size, coalesce(least(p1.w * (SELECT level FROM lv), 3.0 * p1.source_size), 0)::DOUBLE AS target FROM p1),
b AS (SELECT greatest(1, least(4096, floor(min(target) / 512)))::BIGINT AS block FROM p4 WHERE target > 0),
p5 AS (SELECT p4.*, ((source_size + block - 1) // block)::BIGINT AS blocks FROM p4, b),
p6 AS (SELECT *, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0 END AS slots FROM p5),
p7 AS (SELECT *, sum(slots / (SELECT sum(slots) FROM p6)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, max(k) FILTER (slots > 0) OVER () AS last FROM p6),
p8 AS (SELECT *, CASE WHEN k = last THEN 2.0 ELSE upto END AS hi, coalesce(lag(upto) OVER (ORDER BY k), 0) AS lo FROM p7),
i AS (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS x FROM range(0, (SELECT round(sum(slots))::BIGINT FROM p6)) r(i)),
slot AS (SELECT k, blocks, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS r FROM i JOIN p8 ON x >= lo AND x < hi AND slots > 0),
uses AS (SELECT k, r % blocks AS block, count(*) AS uses FROM slot WHERE r < 3 * blocks GROUP BY ALL),
tape AS (SELECT t.*, p5.k, p5.source_size, p5.blocks, p5.target, coalesce(sum(size) OVER (PARTITION BY p5.k ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM t JOIN p5 ON t.source IS NOT DISTINCT FROM p5.source),
took AS (SELECT doc_id, sum((least(a + size, ((block + 1) * source_size) // tape.blocks) - greatest(a, (block * source_size) // tape.blocks)) * uses) AS taken FROM tape JOIN uses USING (k) WHERE (block * source_size) // tape.blocks < a + size AND ((block + 1) * source_size) // tape.blocks > a GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target, coalesce(taken, 0)::BIGINT AS taken, source FROM tape LEFT JOIN took USING (doc_id)
"""

_PIECES = r"array_to_string(list_transform(regexp_extract_all(p, '[^\n.!?]{0,23}(?:[.!?]+ ?|\n|[^\n.!?])'), lambda z: substr(md5(z), 1, 6)), '')"
_PARAGRAPHS = r"list_transform(list_transform(regexp_extract_all(%s, '[^\n]*\n|[^\n]+'), lambda p: substr(md5(p), 1, 12) || '[' || " + _PIECES + r" || ']'), lambda q: q || CASE WHEN substr(q, 12, 1) IN ('0', '1', '2', '3') THEN '|' ELSE ',' END)"
_TREE = r"array_to_string(list_transform(list_filter(string_split(array_to_string(" + _PARAGRAPHS + r", ''), '|'), lambda x: x <> ''), lambda x: substr(md5(regexp_replace(rtrim(x, ','), '\[[0-9a-f]*\]', '', 'g')), 1, 12) || '(' || rtrim(x, ',') || ')'), '')"
_ROOTED = r"md5(regexp_replace({0}, '\([^)]*\)', '', 'g')) || ':' || {0}"
_HELD = r"list_distinct(regexp_extract_all(array_to_string(regexp_extract_all({0}, '\[([0-9a-f]*)\]', 1), ''), '.{{6}}'))"
_OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nxt FROM d),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nxt, 1, length(t) // 2) AS ed FROM n),
v AS (SELECT doc_id, length(t) AS n_chars, sha256(ed) AS edited_sha256, {_TREE % 't'} AS a, {_TREE % 'ed'} AS b, {_TREE % 'nxt'} AS c FROM e),
f AS (SELECT doc_id, n_chars, edited_sha256, {_ROOTED.format('a')} AS fingerprint, {_ROOTED.format('b')} AS edited_fingerprint, {_ROOTED.format('c')} AS next_fingerprint FROM v),
s AS (SELECT *, {_HELD.format('fingerprint')} AS a, {_HELD.format('edited_fingerprint')} AS b, {_HELD.format('next_fingerprint')} AS c FROM f)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END::DOUBLE AS near_edited, CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, c)) / (len(a) + len(c)) END::DOUBLE AS near_next FROM s
"""

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": _OP3,
    "op4_line_dedup": _OP4,
    "op8_mixing": _OP8,
    "op9_merkle": _OP9,
}
