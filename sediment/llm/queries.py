"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import exact_dedup, license_scan, minhash, mixing, packing, quality_classifier, quality_rules, sharding, toxicity, warc
from sediment.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index"))
    found = exact_dedup.deduplicate(docs, index)
    index.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), grams AS (
  SELECT doc_id, p, concat_ws(' ', w[p], w[p + 1], w[p + 2]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words AS f_symbols, 10 * n_dup_lines > 3 * n_lines AS f_lines,
         word_chars > 12 * n_words OR word_chars < 2 * n_words AS f_lengths
  FROM m
), hosts AS (
  SELECT source, rule, count(*) AS n, sum(CAST(failed AS INT)) AS c
  FROM (SELECT source, unnest(['any', 'symbols', 'lines', 'lengths']) AS rule,
               unnest([base_failed OR f_symbols OR f_lines OR f_lengths, f_symbols, f_lines, f_lengths]) AS failed FROM f)
  GROUP BY source, rule
), spread AS (
  SELECT rule, avg(c / n) AS mu, var_pop(c / n) AS v FROM hosts GROUP BY rule
), prior AS (
  SELECT rule, mu, CASE WHEN v > 0 AND v < mu * (1 - mu) THEN least(10000, greatest(1, mu * (1 - mu) / v - 1)) ELSE 100 END AS s FROM spread
), verdict AS (
  SELECT source, max(CASE WHEN rule = 'any' THEN post END) > max(CASE WHEN rule = 'any' THEN mu + 4 * sd END) AND max(CASE WHEN rule = 'any' THEN post END) >= 0.5 AS v_reject,
         max(CASE WHEN rule = 'symbols' THEN post - mu - 0.5 * sd END) > 0 AS v_symbols,
         max(CASE WHEN rule = 'lines' THEN post - mu - 0.5 * sd END) > 0 AS v_lines,
         max(CASE WHEN rule = 'lengths' THEN post - mu - 0.5 * sd END) > 0 AS v_lengths
  FROM (SELECT source, rule, mu, sqrt(mu * (1 - mu) / (s + 1)) AS sd, (c + mu * s) / (n + s) AS post FROM hosts JOIN prior USING (rule)) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR v_reject OR f_symbols AND v_symbols OR f_lines AND v_lines OR f_lengths AND v_lengths) AS kept,
       v_reject AS host_rejected
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP6_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY b) AS crc_of FROM (
    SELECT b, list_reduce([b] || [CAST(0 AS BIGINT) FOR k IN range(0, 8)], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(0, 256)) AS b))
), docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents
), sums AS (
  SELECT doc_id, size, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT) FOR i IN range(0, length(h) // 2)],
                                       lambda c, y: xor(crc_of[(xor(c, y) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) AS crc FROM docs, tab
), numbered AS (
  SELECT doc_id, size, crc, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS row FROM sums
), law AS (
  SELECT n, halves, CAST((CAST(1 AS BIGINT) << halves) - 1 AS BIGINT) AS low,
         [CAST((CAST(20240229 AS HUGEINT) * 2654435761 + k * 40503 + 12345) % 4294967296 AS BIGINT) FOR k IN range(1, 7)] AS keys
  FROM (SELECT count(*) AS n, greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2) AS halves FROM numbered)
), walk AS (
  SELECT row, row >> halves AS l, row & low AS r, 0 AS s FROM numbered, law
  UNION ALL
  SELECT row, r, xor(l, z & low), s + 1 FROM (
    SELECT row, l, r, s, low, xor(y, y >> 13) AS z FROM (
      SELECT row, l, r, s, low, CAST(CAST(xor(x, x >> 15) AS HUGEINT) * 2654435761 % 4294967296 AS BIGINT) AS y FROM (
        SELECT row, l, r, s, low, CAST(CAST(xor(r, keys[s + 1]) AS HUGEINT) * 2654435761 % 4294967296 AS BIGINT) AS x FROM (
          SELECT row, CASE WHEN s = 6 THEN r ELSE l END AS l, CASE WHEN s = 6 THEN l ELSE r END AS r, s % 6 AS s, low, keys
          FROM walk, law WHERE s < 6 OR (r << halves) + l >= n))))
), placed AS (
  SELECT row, (r << halves) + l AS place FROM walk, law WHERE s = 6 AND (r << halves) + l < n
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(place % 8 AS INT) AS shard, place // 8 AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered JOIN placed USING (row)
"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    placed, (_, epoch, block, slot, place) = mixing.mix(docs)
    return placed.select("doc_id", "source", F.col(epoch).alias("epoch"), F.col(block).alias("block"), F.col(slot).alias("slot"), F.col(place).alias("place"))


OP4_SQL = """
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS s, count(*) AS n, pow(count(*), 0.7) AS want FROM documents GROUP BY 1
), rounded AS (
  SELECT s, n, row_number() OVER (ORDER BY s) AS i, greatest(1, CAST(floor(1099511627776 * want / sum(want) OVER () + 0.5) AS BIGINT)) AS p FROM sizes
), parts AS (
  SELECT s, n, i, CAST(p + CASE WHEN row_number() OVER (ORDER BY p DESC, i) = 1 THEN 1099511627776 - sum(p) OVER () ELSE 0 END AS BIGINT) AS p FROM rounded
), small AS (
  SELECT max(CAST(ceil(ceil(n / 64) * 1099511627776 / p) AS BIGINT)) AS h FROM parts
), bs AS (
  SELECT CASE WHEN h > 262144 THEN 64 * CAST(ceil(h / 262144) AS BIGINT) ELSE 64 END AS b FROM small
), sources AS (
  SELECT s, i, p, b, CAST(ceil(n / b) AS BIGINT) AS blocks FROM parts, bs
), shares AS (
  SELECT list(p ORDER BY i) AS ps, max(CAST(ceil(blocks * 1099511627776 / p) AS BIGINT)) AS h FROM sources
), sched AS (
  SELECT 0 AS t, [CAST(0 AS BIGINT) FOR p IN ps] AS done, ps, h, CAST(NULL AS BIGINT) AS c FROM shares
  UNION ALL
  SELECT t + 1, [CASE WHEN j = best THEN done[j] + 1 ELSE done[j] END FOR j IN range(1, len(ps) + 1)], ps, h, best
  FROM (SELECT *, list_min([struct_pack(d := ((done[j] + 1) * 1099511627776 + ps[j] - 1) // ps[j], j := j)
                            FOR j IN range(1, len(ps) + 1) IF done[j] * 1099511627776 // ps[j] <= t]).j AS best
        FROM sched WHERE t < h)
), slots AS (
  SELECT s, b, blocks, t - 1 AS slot, row_number() OVER (PARTITION BY c ORDER BY t) - 1 AS nth FROM sched JOIN sources ON c = i
), ends AS (
  SELECT max(slot) AS e FROM slots WHERE nth = blocks - 1
), numbered AS (
  SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1 AS q FROM documents
)
SELECT doc_id, source, nth // blocks AS epoch, nth AS block, CAST(slot AS BIGINT) AS slot, q % b AS place
FROM numbered JOIN slots ON numbered.s = slots.s AND q // b = nth % blocks, ends
WHERE slot <= e
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op9_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)
), ends AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT ends.b, reach.c FROM reach JOIN ends ON ends.a = reach.a WHERE reach.c < ends.b
), least AS (
  SELECT a AS doc_id, min(c) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""


def op10_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("digest_ok")


OP10_SQL = """
WITH h AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM h),
e AS (
  SELECT page_id, payload_bytes,
         translate(list_aggregate([lpad(upper(to_base(CAST('0x' || x[1 + 10 * i : 10 + 10 * i] AS BIGINT), 32)), 8, '0') FOR i IN range(0, 4)], 'string_agg', ''),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM d
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM e)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pfair_mixing": op4_pfair_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_feistel_sharding": op6_feistel_sharding,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_compression_toxicity": op8_compression_toxicity,
    "op9_setsketch_dedup": op9_setsketch_dedup,
    "op10_warc_assembly": op10_warc_assembly,
}
SQL = {"op2_exact_dedup": OP2_SQL, "op4_pfair_mixing": OP4_SQL, "op5_quality_rules": OP5_SQL, "op6_feistel_sharding": OP6_SQL, "op9_setsketch_dedup": OP9_SQL, "op10_warc_assembly": OP10_SQL}
