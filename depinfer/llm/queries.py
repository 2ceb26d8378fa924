"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depinfer.llm import op1_token_orc, op10_topk, op2_decontaminate, op3_licenses, op4_extract, op5_suffix_dedup, op6_warc, op7_packing, op8_quality, op9_minhash
from depinfer.llm.common import table, work_dir


def op1_token_orc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "op1")
    op1_token_orc.write_token_orc(table(spark, sf_dir, "documents"), path)
    return op1_token_orc.token_digests(op1_token_orc.read_token_orc(spark, path))


def op2_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op3_licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licenses.scan_licenses(table(spark, sf_dir, "documents"))


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Every unit against every template that shares a bigram, without size bounds.
OP3_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS template, license, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\n]+', ' ', 'g'), '[ \n]+', ' ', 'g')), ' ') AS words
  FROM (VALUES TEMPLATES) AS v(license, text)
), tb AS (
  SELECT template, license, len(words) - 1 AS m, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigram FROM t
), tc AS (
  SELECT template, license, m, bigram, count(*) AS times FROM tb GROUP BY ALL
), d AS (
  SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\n]+', ' ', 'g') AS text FROM documents
), u AS (
  SELECT doc_id, 0 AS unit, text AS said FROM d
  UNION ALL SELECT doc_id, 1, unnest(string_split_regex(text, '\n *(?:\n *)+')) FROM d WHERE regexp_matches(text, '\n *\n')
  UNION ALL SELECT doc_id, 2, unnest(string_split(text, chr(10))) FROM d WHERE contains(text, chr(10))
), w AS (
  SELECT row_number() OVER () AS k, doc_id, unit, string_split(trim(regexp_replace(said, '[ \n]+', ' ', 'g')), ' ') AS words FROM u
), b AS (
  SELECT k, doc_id, unit, len(words) - 1 AS n, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigram FROM w WHERE len(words) >= 2
), c AS (
  SELECT k, doc_id, unit, n, bigram, count(*) AS times FROM b GROUP BY ALL
), s AS (
  SELECT k, doc_id, unit, license, 2 * sum(least(c.times, tc.times)) / (n + m)::DOUBLE AS dice FROM c JOIN tc USING (bigram) GROUP BY k, doc_id, unit, n, template, license, m
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, unit) AS place FROM s WHERE dice >= 0.8
)
SELECT doc_id, license, round(dice, 6) AS dice, CAST(unit AS INTEGER) AS unit FROM r WHERE place = 1
""".replace("TEMPLATES", ", ".join(f"({_literal(n)}, {_literal(x)})" for n, x in op3_licenses.TEMPLATES))


def op4_extract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_suffix_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


#: All 200-byte strings as hexadecimal digits; texts are cut first, since a substring costs its place.
OP5_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT doc_id, q, substr(h, 2 * q + 1, 910) AS piece FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 - 199 AS BIGINT), 256)) AS q FROM d)
), s AS MATERIALIZED (
  SELECT doc_id, q + i AS p, md5_number(substr(piece, 2 * i + 1, 400)) AS name FROM (SELECT doc_id, q, piece, unnest(range(CAST(len(piece) // 2 - 199 AS BIGINT))) AS i FROM pieces)
), hits AS (
  SELECT doc_id, p FROM s WHERE name IN (SELECT name FROM s GROUP BY name HAVING count(*) > 1)
), runs AS (
  SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS opens FROM hits)
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op6_warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = op6_warc.write_warc(table(spark, sf_dir, "pages"), work_dir(spark, "op6-warc"))
    captures = op6_warc.assemble_transactions(op6_warc.read_warc(manifest, with_payload=False))
    return captures.select(
        F.col("metadata")["page-id"].cast("long").alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        F.col("metadata")["refers-to-page-id"].cast("long").alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""


def op7_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_packing.pack(table(spark, sf_dir, "documents"))


def op8_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality.predict_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w
), e AS MATERIALIZED (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), ends AS MATERIALIZED (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN ends ON node = x
), c AS (
  SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""


def op10_topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_topk.top_k(table(spark, sf_dir, "embeddings"))


#: The exact search in SQL: integer components, every query against every other row.
OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict:
    return {
        "op1_token_orc": op1_token_orc_query,
        "op2_decontaminate": op2_decontaminate_query,
        "op3_licenses": op3_licenses_query,
        "op4_extract": op4_extract_query,
        "op5_suffix_dedup": op5_suffix_dedup_query,
        "op6_warc": op6_warc_query,
        "op7_packing": op7_packing_query,
        "op8_quality": op8_quality_query,
        "op9_minhash": op9_minhash_query,
        "op10_topk": op10_topk_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": OP3_SQL, "op5_suffix_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op9_minhash": OP9_SQL, "op10_topk": OP10_SQL}
