"""The queries opN_<name>: each operator over its whole table, with the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, exact_dedup, hard_negatives, lm, mixing, near_dedup, packing, quality, substring_dedup, token_files, topk, warc, whitening

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), shingle=3, numerator=85, denominator=100, bands=30, rows=6)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(_table(spark, sf_dir, "documents"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return token_files.read_tokens(listed, digests=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = warc.write_warc(_table(spark, sf_dir, "pages"))
    return warc.read_warc(listed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, _ = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return places.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_repeated_passages, op3_minhash_near_dedup, op4_lm_scores, op5_quality_crf, op6_mix_sources, op7_top_k, op8_token_files, op9_warc, op10_bpe, op11_packing, op12_hard_negatives, op13_whitening)}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op2_repeated_passages": r"""
        WITH x AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS a FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
             r AS (SELECT rid, doc_id, unnest(a) AS run, generate_subscripts(a, 1) AS k FROM x),
             p AS (SELECT rid, doc_id, k, run, octet_length(encode(run)) AS n, length(run) AS c, sum(octet_length(encode(run))) OVER o AS stop, sum(length(run)) OVER o AS c_stop FROM r WINDOW o AS (PARTITION BY rid ORDER BY k)),
             w AS (SELECT rid, doc_id, row_number() OVER (PARTITION BY rid ORDER BY k) AS i, stop - n AS start, stop, c_stop - c AS c_start, c_stop FROM p WHERE regexp_matches(run, '^[^\x20\x09-\x0D]')),
             v AS (SELECT *, lead(stop, 50) OVER o AS last, lead(c_stop, 50) OVER o AS c_last FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
             h AS (SELECT v.rid, v.doc_id, i, start, last, md5(substr(text, CAST(c_start + 1 AS BIGINT), CAST(c_last - c_start AS BIGINT))) AS h FROM v JOIN x USING (rid) WHERE last IS NOT NULL),
             f AS (SELECT h, min(doc_id) AS f FROM h GROUP BY h),
             b AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) < 51 THEN 0 ELSE 1 END AS begins FROM h JOIN f USING (h) WHERE f < doc_id),
             g AS (SELECT *, sum(begins) OVER (PARTITION BY rid ORDER BY i) AS g FROM b)
        SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(last) AS BIGINT) AS "end", CAST(max(i) - min(i) + 51 AS BIGINT) AS words, arg_min(f, i) AS first_doc_id FROM g GROUP BY rid, doc_id, g""",
    "op6_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS DOUBLE) AS cap, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
             l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight
                   FROM s WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             t AS (SELECT *, cap * weight <= rest * w AS stops FROM l),
             u AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE (sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE stops) OVER (), 0)) * w / sum(w) FILTER (WHERE NOT stops) OVER () END AS target,
                          CAST('0x' || substr(md5(coalesce(source, 'null:') || ':20'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS o FROM t),
             r AS (SELECT d.doc_id, d.source, size, source_size, target, o, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS k
                   FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
             c AS (SELECT *, CAST(floor((k + 1) * rate + o) - floor(k * rate + o) AS BIGINT) AS copies FROM r)
        SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c""",
    "op7_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                       ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
             e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
             r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS top, sha1(b) AS h FROM p)
        SELECT page_id, octet_length(b) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                   FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
                   FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
        SELECT * FROM n WHERE rank <= 5""",
}
