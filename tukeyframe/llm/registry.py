"""The queries of the training-data operators, and the SQL that some of them are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tukeyframe.llm import cotrain, decontaminate, langid, neardup, packing, quotes, secrets, sharding, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_secret_scan that SQL can express."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents.select("doc_id", "text"), langid.fit(documents))
    return found.select("doc_id", (langid.remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20


def op4_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.round_trip(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def quotation_linking_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over conversations in which every odd turn quotes the one before: links, depths and order that SQL must match."""
    return quotes.conversations(quotes.with_replies(table(spark, sf_dir, "conversations")))


def op10_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return cotrain.score(documents, cotrain.fit(documents, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_quotation_linking": op1_quotation_linking,
    "quotation_linking_replies": quotation_linking_replies,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_extendible_hashing": op4_extendible_hashing,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_exact_topk": op6_exact_topk,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op2_warc_normaliser": op2_warc_normaliser,
    "op8_language_id": op8_language_id,
    "op7_secret_scan": op7_secret_scan,
    "secret_base_spans": secret_base_spans,
    "op10_quality_cotraining": op10_quality_cotraining,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quotation_linking": quotes.SQL.format(table="conversations"),
    "quotation_linking_replies": quotes.SQL.format(table=quotes.REPLIES_SQL),
    # base32 takes five bits at a time, which lie within two digits of the hexadecimal digest
    "op2_warc_normaliser": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
w AS (SELECT hex, max(page_id) AS winner FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
         (((instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
           + instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1) >> CAST(3 - 5 * i % 4 AS BIGINT)) & 31) AS BIGINT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM p JOIN w USING (hex)
""",
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    # the depth of a row's shard is the least at which the rows that share its prefix fit, or are of one hash
    "op4_extendible_hashing": f"""
WITH r AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
d AS (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 61)),
s AS (SELECT depth, h >> (60 - depth) AS p, sum(bytes) AS total, min(h) = max(h) AS one FROM r, d GROUP BY ALL),
m AS (SELECT h, min(s.depth) AS depth FROM (SELECT DISTINCT h FROM r) k, s
      WHERE s.p = k.h >> (60 - s.depth) AND (s.total <= {SHARD_BYTES} OR s.one) GROUP BY h)
SELECT doc_id, bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard
FROM r JOIN m USING (h)
""",
    "op5_benchmark_decontamination": decontaminate.SQL,
    "secret_base_spans": secrets.BASE_SQL,
    "op6_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
