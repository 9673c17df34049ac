"""The corpus operators bound to the tables of a data folder, and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, html, jaccard, mixing, pii, sharding, substring, toxicity, warc
from .common import table


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"), k=13, keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), F.octet_length("text"), by=["doc_id"])
    folder = warc.archive_folder(spark, "shards")
    sharding.write_shards(placed, folder)
    written = sharding.read_shards(spark, folder, placed.schema)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("row_bytes")
    return written.select("doc_id", *[size if c == "row_bytes" else c for c in sharding.RESULT])


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, is_query=F.col("vec_id") % 20 == 0, k=20)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting spark.ordinate.pii.key; without it one is drawn that nobody keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.ordinate.pii.key", None) or secrets.token_hex(32)
    return pii.with_surrogates(docs, key=key).select("doc_id", "text", "n_entities")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).drop("url")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out(F.col("id")))
    found = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    return found.select("doc_id", "held_out", "score", "predicted", "n_tokens", "evidence")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "path")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

SQL = {
    "op1_substring": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
wins AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
copied AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM wins)
    WHERE least < doc_id OR doc_id IS NULL AND least IS NOT NULL),
gone AS (SELECT rid, list(DISTINCT p) AS p FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM copied) GROUP BY rid),
kept AS (SELECT d.rid, doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
    CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END AS k FROM d LEFT JOIN gone USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
""",
    "op2_sharding": """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS size,
    row_number() OVER (PARTITION BY doc_id, strlen(text)) AS copy FROM documents),
h AS (SELECT *, ('0x' || substr(md5(coalesce('=' || doc_id, 'null') || '|=' || size || '|' || copy), 1, 15))::BIGINT AS h FROM d),
lv AS (SELECT h.*, t.depth, CASE WHEN t.depth = 0 THEN '' ELSE substr(lpad(bin(h), 60, '0'), 1, t.depth::INT) END AS shard
    FROM h, (SELECT unnest(range(0, 61)) AS depth) t),
s AS (SELECT *, sum(size) OVER (PARTITION BY depth, shard) AS shard_bytes, count(*) OVER (PARTITION BY depth, shard) AS shard_rows FROM lv),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, copy, size ORDER BY depth) AS rn FROM s
    WHERE shard_bytes <= 67108864 OR shard_rows = 1 OR depth = 60)
SELECT doc_id, size AS row_bytes, shard, depth::INT AS shard_depth, shard_bytes::BIGINT AS shard_bytes, shard_rows,
    shard_bytes > 67108864 AS oversize FROM best WHERE rn = 1
""",
    "op5_mixing": """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
m AS (SELECT *, coalesce('=' || source, 'null') AS mark, length(bin(size)) AS bits,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS h FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY bits * 64 + (size >> greatest(bits - 5, 0)::INT), h % 256, (h >> 8) % 256, size, h, doc_id NULLS FIRST) AS k FROM m),
t AS (SELECT mark, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM p GROUP BY mark),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM t),
r AS (SELECT *, 3.0::DOUBLE * source_size AS lim, 3.0::DOUBLE * source_size / weight AS reach FROM w),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER b, 0) AS lw,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS lg FROM r
    WINDOW b AS (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN lw / lg < reach THEN lw / lg END AS own FROM l),
g AS (SELECT *, first_value(own IGNORE NULLS) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM v),
q AS (SELECT mark, source_size, coalesce(least(lim, level * weight), lim) AS target,
    ('0x' || substr(md5('mix|offset|' || mark), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM g),
c AS (SELECT p.doc_id, p.source, p.size, q.source_size, q.target,
    CASE WHEN q.source_size > 0 THEN q.target / q.source_size ELSE 0 END AS rate, u, k FROM p JOIN q USING (mark)),
e AS (SELECT *, (floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM e
""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
    row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS rn, max(page_id) OVER (PARTITION BY body) AS top FROM p),
c AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT) AS v FROM d)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((x >> b) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
    CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN rn > 1 THEN top END AS refers_to FROM c
""",
    "op9_decontamination": r"""
WITH d0 AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
d AS (SELECT row_number() OVER () AS rid, * FROM d0),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
wins AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM pat))),
occ AS (SELECT rid, i, wins.n, item_id FROM wins JOIN pat USING (n, s)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
""",
}

SQL["op10_jaccard"] = r"""
WITH RECURSIVE d0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
d AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d0),
sets AS (SELECT hash(list_sort(s)) AS c, any_value(s) AS s, len(any_value(s)) AS n FROM d WHERE len(s) > 0 GROUP BY hash(list_sort(s))),
tok AS (SELECT c, n, unnest(s) AS t FROM sets),
inter AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS k FROM tok a JOIN tok b ON a.t = b.t AND a.c < b.c
    AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM inter WHERE 100 * k >= 75 * (na + nb - k)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS v, a AS r FROM e2 UNION SELECT e2.b, reach.r FROM reach JOIN e2 ON reach.v = e2.a),
m AS (SELECT hash(list_sort(s)) AS c, min(doc_id) AS least FROM d WHERE len(s) > 0 GROUP BY 1),
comp AS (SELECT reach.v AS c, min(m.least) AS id FROM reach JOIN m ON m.c = reach.r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE coalesce(comp.id, m.least) END AS component_id
FROM d LEFT JOIN m ON len(s) > 0 AND m.c = hash(list_sort(s)) LEFT JOIN comp ON comp.c = m.c
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
