"""The registered queries over the deduplication tables, and their SQL.

All read whole tables. Text columns are the files: chunks of a fixed size in
built-in functions where SQL is to give the same rows. What SQL can't compute (gear
cuts, BLAKE3, xxh3, zstandard) is reported by what must hold of it: chunks cover
their document within the size bounds and join to its digest, hashes are equal exactly
where the bytes are, payloads and deltas decode to what went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.config import FINE, TEXT, BackupOptions, ChunkConfig, SimilarityConfig
from sediment.functions import codec, features
from sediment.operators import dedup, manifest, similarity
from sediment.operators.chunking import cdc_chunks, fixed_chunks, hashed
from sediment.session import row_numbers, scratch_path, staged
from sediment.sources.files import from_table
from sediment.sources.store import ChunkStore

SMALL, MIDDLE, LARGE = 256, 512, 1024
SEQ = 1 << 24  # more chunks than a cell of 2 GiB can have, in the order number doc_id * SEQ + chunk_no


def _docs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", *keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))


def _chunks(spark: SparkSession, sf_dir: str, size: int, *keep: str) -> DataFrame:
    """doc_id, ``keep``, chunk_no, offset, length, data, hash."""
    return hashed(fixed_chunks(_docs(spark, sf_dir, *keep), size, keep=["doc_id", *keep]))


def _sql(size: int, keep: str = "") -> str:
    """A WITH clause whose table ``c`` is what _chunks gives."""
    k = f"{keep}, " if keep else ""
    return f"""
WITH d AS (SELECT doc_id, {k}encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, {k}b, unnest(range(0, (octet_length(b) + {size - 1}) // {size})) AS chunk_no FROM d),
c AS (SELECT doc_id, {k}CAST(chunk_no AS INT) AS chunk_no, chunk_no * {size} AS "offset", b[chunk_no * {size} + 1 : (chunk_no + 1) * {size}] AS data,
      CAST(octet_length(b[chunk_no * {size} + 1 : (chunk_no + 1) * {size}]) AS INT) AS length, sha256(b[chunk_no * {size} + 1 : (chunk_no + 1) * {size}]) AS hash FROM n)"""


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# hashes and exact duplicates


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents")
def doc_content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("n_bytes"))


@query("SELECT sha256(coalesce(text, '')) AS hash, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.sha2("content", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id")).where("copies > 1")


def _ratio_sql(group: str) -> str:
    return _sql(SMALL, group) + f""",
f AS (SELECT {group}, length, row_number() OVER (PARTITION BY hash ORDER BY doc_id, chunk_no) AS r FROM c)
SELECT {group}, count(*) AS total_chunks, count(*) FILTER (r = 1) AS new_chunks, CAST(sum(length) AS BIGINT) AS source_bytes,
       CAST(coalesce(sum(length) FILTER (r = 1), 0) AS BIGINT) AS stored_bytes,
       round(CASE WHEN coalesce(sum(length) FILTER (r = 1), 0) = 0 THEN 1.0 ELSE sum(length)::DOUBLE / sum(length) FILTER (r = 1) END, 6) AS dedup_ratio,
       round((1 - coalesce(sum(length) FILTER (r = 1), 0)::DOUBLE / sum(length)) * 100, 6) AS savings_pct
FROM f GROUP BY {group}"""


@query(_ratio_sql("source"))
def dedup_ratio_by_source(spark, sf_dir):
    return dedup.dedup_stats(_chunks(spark, sf_dir, SMALL, "source"), "source", ["doc_id", "chunk_no"])


@query(_ratio_sql("lang"))
def dedup_ratio_by_lang(spark, sf_dir):
    return dedup.dedup_stats(_chunks(spark, sf_dir, SMALL, "lang"), "lang", ["doc_id", "chunk_no"])


# chunks


@query(_sql(MIDDLE) + 'SELECT doc_id, chunk_no, "offset", length, hash FROM c')
def fixed_chunk_explode(spark, sf_dir):
    return _chunks(spark, sf_dir, MIDDLE).select("doc_id", "chunk_no", "offset", "length", "hash")


@query(_sql(SMALL) + """
SELECT hash, doc_id, chunk_no, length, refs FROM (
  SELECT *, count(*) OVER (PARTITION BY hash) AS refs, row_number() OVER (PARTITION BY hash ORDER BY doc_id, chunk_no) AS r FROM c) WHERE r = 1""")
def chunk_dedup_first_occurrence(spark, sf_dir):
    return dedup.first_occurrences(_chunks(spark, sf_dir, SMALL), ["doc_id", "chunk_no"], ["length"]).select("hash", "doc_id", "chunk_no", "length", "refs")


@query(_ratio_sql("doc_id").replace("SELECT doc_id, doc_id, encode", "SELECT doc_id, encode").replace("doc_id, doc_id, b,", "doc_id, b,").replace("SELECT doc_id, doc_id, CAST", "SELECT doc_id, CAST"))
def chunk_dedup_stats_per_doc(spark, sf_dir):
    return dedup.dedup_stats(_chunks(spark, sf_dir, SMALL), "doc_id", ["doc_id", "chunk_no"])


@query(_sql(SMALL) + "SELECT hash, count(*) AS refs, count(DISTINCT doc_id) AS docs FROM c GROUP BY hash")
def chunk_reference_counts(spark, sf_dir):
    per_doc = _chunks(spark, sf_dir, SMALL).groupBy("hash", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("hash").agg(F.sum("n").alias("refs"), F.count("*").alias("docs"))


@query(_sql(SMALL) + "SELECT hash, count(*) AS refs, CAST(sum(length) AS BIGINT) AS bytes FROM c GROUP BY hash ORDER BY refs DESC, hash LIMIT 20")
def top_shared_chunks(spark, sf_dir):
    shared = _chunks(spark, sf_dir, SMALL).groupBy("hash").agg(F.count("*").alias("refs"), F.sum(F.col("length").cast("long")).alias("bytes"))
    return shared.orderBy(F.desc("refs"), "hash").limit(20)


@query(_sql(SMALL, "source") + "SELECT hash, count(DISTINCT source) AS sources, count(*) AS refs FROM c GROUP BY hash HAVING count(DISTINCT source) > 1")
def cross_source_shared_chunks(spark, sf_dir):
    by_source = _chunks(spark, sf_dir, SMALL, "source").groupBy("hash", "source").agg(F.count("*").alias("n"))
    return by_source.groupBy("hash").agg(F.count("source").alias("sources"), F.sum("n").alias("refs")).where("sources > 1")


@query(_sql(MIDDLE) + """, o AS (SELECT doc_id, chunk_no, length, "offset", coalesce(sum(length) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM c)
SELECT doc_id, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes, bool_and("offset" = w) AS contiguous FROM o GROUP BY doc_id""")
def chunk_offset_invariant(spark, sf_dir):
    before = F.coalesce(F.sum("length").over(Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = _chunks(spark, sf_dir, MIDDLE).select("doc_id", "chunk_no", "offset", "length").withColumn("fits", F.col("offset") == before)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.col("length").cast("long")).alias("bytes"), F.bool_and("fits").alias("contiguous"))


@query(_sql(SMALL) + "SELECT count(*) AS chunks, count(DISTINCT hash) AS distinct_chunks FROM c")
def index_cardinality(spark, sf_dir):
    refs = _chunks(spark, sf_dir, SMALL).groupBy("hash").agg(F.count("*").alias("n"))
    return refs.agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"))


PACK_SQL = _sql(LARGE) + """, f AS (SELECT hash, min((doc_id, chunk_no)) AS k, any_value(length) AS length FROM c GROUP BY hash),
g AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS place FROM f),
r AS (SELECT place // 64 AS run, sum(length) AS b FROM g GROUP BY 1),
p AS (SELECT run, CAST(coalesce(sum(b) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1048576 AS BIGINT) AS pack_id FROM r)
"""


def _packs(spark, sf_dir) -> DataFrame:
    """pack_id, hash, length: first occurrences in packs of about 1 MiB, by running size of runs of 64."""
    firsts = dedup.first_occurrences(_chunks(spark, sf_dir, LARGE), ["doc_id", "chunk_no"], ["length"])
    placed, _ = row_numbers(firsts, ["doc_id", "chunk_no"], "place", "pack-places")
    runs = placed.groupBy(F.expr("place div 64").alias("run")).agg(F.sum("length").alias("b"))
    upto = F.sum("b").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    packs = runs.select("run", F.floor(F.coalesce(upto, F.lit(0)) / F.lit(1 << 20)).cast("long").alias("pack_id"))
    return placed.withColumn("run", F.expr("place div 64")).join(packs, "run").select("pack_id", "hash", "length")


@query(PACK_SQL + "SELECT pack_id, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes FROM g JOIN p ON g.place // 64 = p.run GROUP BY pack_id")
def pack_assignment(spark, sf_dir):
    return _packs(spark, sf_dir).groupBy("pack_id").agg(F.count("*").alias("chunks"), F.sum(F.col("length").cast("long")).alias("bytes"))


@query(PACK_SQL + "SELECT pack_id, sha256(string_agg(hash, '' ORDER BY hash)) AS checksum FROM g JOIN p ON g.place // 64 = p.run GROUP BY pack_id")
def pack_checksums(spark, sf_dir):
    return _packs(spark, sf_dir).groupBy("pack_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), ""), 256).alias("checksum"))


# manifests, restore, verify


@query(_sql(MIDDLE) + "SELECT d.doc_id, count(hash) AS n_chunks, coalesce(string_agg(hash, ',' ORDER BY chunk_no), '') AS chunk_hashes FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id")
def manifest_build(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id")
    built = manifest.build_manifests(docs, _chunks(spark, sf_dir, MIDDLE), "doc_id")
    return built.select("doc_id", F.size("chunk_hashes").cast("long").alias("n_chunks"), F.concat_ws(",", "chunk_hashes").alias("chunk_hashes"))


@query("SELECT doc_id, sha256(text) AS digest, true AS same FROM documents WHERE text <> ''")
def manifest_restore_digest(spark, sf_dir):
    """Documents put together again from a table of distinct chunks have the hashes they had."""
    chunks = _chunks(spark, sf_dir, MIDDLE)
    store = staged(chunks.groupBy("hash").agg(F.first("data").alias("data")), "restore-store")
    met = chunks.select("doc_id", "chunk_no", "hash").join(store, "hash")
    parts = met.groupBy("doc_id").agg(manifest.ordered(F.hex("data"), F.col("chunk_no")).alias("parts"))
    digest = F.sha2(F.unhex(F.array_join("parts", "")), 256)
    original = _docs(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("was"))
    return parts.select("doc_id", digest.alias("digest")).join(original, "doc_id").select("doc_id", "digest", (F.col("digest") == F.col("was")).alias("same"))


def _verify(spark, sf_dir, lost=None, broken=None):
    chunks = _chunks(spark, sf_dir, MIDDLE)
    data = F.col("data") if broken is None else F.when(broken, F.concat(F.col("data"), F.lit(b"x"))).otherwise(F.col("data"))
    held = chunks if lost is None else chunks.where(~lost)
    held = held.select("hash", F.sha2(data, 256).alias("actual")).groupBy("hash").agg(F.first("actual").alias("actual"))  # bytes stay out of the exchange
    manifests = manifest.build_manifests(_docs(spark, sf_dir).select("doc_id"), chunks, "doc_id").withColumnRenamed("doc_id", "name")
    return manifest.verify_report(manifests, manifest.verify(manifests, held))


@query(_sql(MIDDLE) + "SELECT (SELECT count(*) FROM documents) AS files_checked, count(*) AS chunks_checked, CAST(0 AS BIGINT) AS errors, true AS ok FROM c")
def verify_report_ok(spark, sf_dir):
    return _verify(spark, sf_dir)


@query(_sql(MIDDLE) + "SELECT (SELECT count(*) FROM documents) AS files_checked, count(*) AS chunks_checked, count(*) FILTER (hash LIKE '0%' OR hash LIKE '10%') AS errors, count(*) FILTER (hash LIKE '0%' OR hash LIKE '10%') = 0 AS ok FROM c")
def verify_report_corrupted(spark, sf_dir):
    """Chunks whose hash begins with 0 are lost and those with 10 changed."""
    return _verify(spark, sf_dir, F.col("hash").startswith("0"), F.col("hash").startswith("10"))


@query(_sql(MIDDLE) + "SELECT (SELECT count(*) FROM d) AS file_count, (SELECT CAST(sum(octet_length(b)) AS BIGINT) FROM d) AS total_size, count(*) AS total_chunks FROM c")
def store_info(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.octet_length("content").cast("long").alias("size"))
    return manifest.store_info(manifest.build_manifests(docs, _chunks(spark, sf_dir, MIDDLE), "doc_id"))


@query(_sql(MIDDLE) + "SELECT CAST(d.doc_id AS VARCHAR) AS name, CAST(octet_length(any_value(b)) AS BIGINT) AS size, CAST(0 AS BIGINT) AS modified, CAST(count(hash) AS INT) AS chunk_count FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id")
def list_files(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.octet_length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("modified"))
    built = manifest.build_manifests(docs, _chunks(spark, sf_dir, MIDDLE), "doc_id").withColumn("name", F.col("doc_id").cast("string"))
    return manifest.list_files(built)


@query("SELECT CAST(doc_id AS VARCHAR) AS name, octet_length(encode(coalesce(text, ''))) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, doc_id % 5 AS modified FROM documents WHERE doc_id % 2 = 1 OR doc_id % 7 = 0")
def incremental_new_or_changed(spark, sf_dir):
    """Against a state with the even ids, every seventh of all documents has another size now."""
    rows = _docs(spark, sf_dir).select(F.col("doc_id"), F.col("doc_id").cast("string").alias("name"), F.octet_length("content").cast("long").alias("size"), (F.col("doc_id") % 5).alias("modified"))
    now = rows.withColumn("size", F.col("size") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).drop("doc_id")
    return manifest.changed(now, rows.where("doc_id % 2 = 0")).select("name", "size", "modified")


@query(_sql(SMALL) + ", s AS (SELECT DISTINCT hash FROM c WHERE doc_id % 2 = 0) SELECT hash, min(doc_id) AS doc_id, count(*) AS refs FROM c WHERE doc_id % 2 = 1 AND hash NOT IN (SELECT hash FROM s) GROUP BY hash")
def left_anti_new_chunks(spark, sf_dir):
    """Chunks of documents with odd ids that a store of the even ones lacks."""
    chunks = _chunks(spark, sf_dir, SMALL).select("doc_id", "chunk_no", "hash")
    stored = dedup.first_occurrences(chunks.where("doc_id % 2 = 0"), ["doc_id"], [])
    return dedup.new_chunks(dedup.first_occurrences(chunks.where("doc_id % 2 = 1"), ["doc_id"], []), stored).select("hash", "doc_id", "refs")


@query(_sql(SMALL) + ", s AS (SELECT hash, any_value(length) AS length FROM c GROUP BY hash) SELECT hash, length FROM s WHERE hash NOT IN (SELECT hash FROM c WHERE doc_id % 3 <> 0)")
def orphan_chunks(spark, sf_dir):
    """Chunks left when every third document is deleted."""
    chunks = _chunks(spark, sf_dir, SMALL).select("doc_id", "chunk_no", "hash", "length")
    index = chunks.groupBy("hash").agg(F.first("length").alias("length")).withColumn("base_hash", F.lit(None).cast("string"))
    kept = chunks.where("doc_id % 3 <> 0")
    manifests = manifest.build_manifests(kept.select("doc_id").distinct(), kept, "doc_id").withColumnRenamed("doc_id", "name")
    return manifest.orphans(index, manifests).select("hash", "length")


@query(_sql(SMALL) + """, t AS (SELECT DISTINCT hash FROM c WHERE doc_id % 4 = 0)
SELECT hash, any_value(length) AS length FROM c WHERE hash NOT IN (SELECT hash FROM t) GROUP BY hash""")
def migrate_missing_chunks(spark, sf_dir):
    """What a store of every fourth document lacks of the whole."""
    chunks = _chunks(spark, sf_dir, SMALL).select("doc_id", "hash", "length")
    target = chunks.where("doc_id % 4 = 0").select("hash").distinct()
    return chunks.groupBy("hash").agg(F.first("length").alias("length")).join(target, "hash", "left_anti")


# signatures and near-duplicates

SIGNED_SQL = _sql(LARGE) + """,
u AS (SELECT hash, min(doc_id * 16777216 + chunk_no) AS seq, any_value(data) AS data, any_value(length) AS length FROM c GROUP BY hash),
ft AS (SELECT hash, seq, length, CASE WHEN length < 64 THEN NULL WHEN length < 256 THEN [md5(data)[1:16] FOR i IN range(0, 12)]
       ELSE [md5(data[i * (length // 12) + 1 : i * (length // 12) + least(32, length // 12)])[1:16] FOR i IN range(0, 12)] END AS f FROM u),
k AS (SELECT hash, seq, tier, slot, CASE WHEN length < 256 THEN f[1] ELSE array_to_string(f[slot * w + 1 : slot * w + w], '-') END AS sf
      FROM ft, (VALUES (3, 4, 0), (3, 4, 1), (3, 4, 2), (2, 3, 0), (2, 3, 1), (2, 3, 2), (2, 3, 3), (1, 2, 0), (1, 2, 1), (1, 2, 2), (1, 2, 3), (1, 2, 4), (1, 2, 5)) AS v(tier, w, slot)
      WHERE f IS NOT NULL),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier, slot, sf ORDER BY seq) AS r FROM k) WHERE r <= 5),
cand AS (SELECT q.hash, b.hash AS base_hash, b.seq AS base_seq, q.tier, count(*) AS matches, min(q.slot) AS first_slot
         FROM k q JOIN bs b ON q.tier = b.tier AND q.slot = b.slot AND q.sf = b.sf AND b.seq < q.seq GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY tier DESC, matches DESC, first_slot, base_seq) AS r FROM cand) WHERE r = 1)"""


def _distinct(spark, sf_dir) -> DataFrame:
    """hash, seq, length, data of distinct chunks."""
    chunks = _chunks(spark, sf_dir, LARGE).withColumn("seq", F.col("doc_id") * SEQ + F.col("chunk_no"))
    return chunks.groupBy("hash").agg(F.min("seq").alias("seq"), F.first("length").alias("length"), F.first("data").alias("data"))


def _signed(spark, sf_dir) -> DataFrame:
    """hash, seq, length, keys."""
    unique = _distinct(spark, sf_dir)
    keyed = unique.select("hash", "seq", "length", features.sql_features(F.col("data")).alias("f"))
    return staged(keyed.select("hash", "seq", "length", features.sql_keys(F.col("f"), F.col("length")).alias("keys")), "signed")


@query(_sql(LARGE) + "SELECT CASE WHEN length < 64 THEN 'none' WHEN length < 256 THEN 'whole' ELSE 'sampled' END AS size_class, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes FROM c GROUP BY 1")
def signature_size_class(spark, sf_dir):
    return _chunks(spark, sf_dir, LARGE).groupBy(features.size_class(F.col("length")).alias("size_class")).agg(F.count("*").alias("chunks"), F.sum(F.col("length").cast("long")).alias("bytes"))


@query(SIGNED_SQL + "SELECT hash, length, array_to_string(f, ',') AS features FROM ft")
def signature_features_md5(spark, sf_dir):
    unique = _distinct(spark, sf_dir)
    return unique.select("hash", "length", features.sql_features(F.col("data")).alias("f")).select("hash", "length", F.when(F.col("f").isNotNull(), F.concat_ws(",", "f")).alias("features"))


@query(SIGNED_SQL + "SELECT tier, slot, sf, count(*) AS chunks, min(seq) AS first_seq FROM k GROUP BY ALL HAVING count(*) > 1")
def super_feature_buckets(spark, sf_dir):
    slots = similarity.exploded(_signed(spark, sf_dir), ["hash", "seq"])
    return slots.groupBy("tier", "slot", "sf").agg(F.count("*").alias("chunks"), F.min("seq").alias("first_seq")).where("chunks > 1")


@query(SIGNED_SQL + "SELECT count(DISTINCT hash) AS chunks, count(*) AS slots, count(DISTINCT (tier, slot, sf)) AS buckets FROM k")
def similarity_index_size(spark, sf_dir):
    return similarity.index_size(_signed(spark, sf_dir))


def _candidates(spark, sf_dir):
    slots = similarity.exploded(_signed(spark, sf_dir), ["hash", "seq"])
    return similarity.candidates(slots, similarity.bases(slots, "seq", 5))


@query(SIGNED_SQL + "SELECT hash, base_hash, base_seq, tier, matches, first_slot FROM cand")
def near_dup_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(SIGNED_SQL + "SELECT hash, base_hash, tier, matches, first_slot, base_seq FROM best")
def near_dup_best_match(spark, sf_dir):
    return similarity.best(_candidates(spark, sf_dir))


@query(SIGNED_SQL + """, t AS (SELECT unnest([0.7, 0.8, 0.9]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, CASE WHEN length < 64 THEN 'too_small' WHEN tier >= CASE WHEN threshold <= 0.7 THEN 1 WHEN threshold <= 0.85 THEN 2 ELSE 3 END THEN 'near_duplicate' ELSE 'unique' END AS outcome, count(*) AS chunks
FROM u LEFT JOIN best USING (hash), t GROUP BY 1, 2""")
def near_dup_threshold_gate(spark, sf_dir):
    signed = _signed(spark, sf_dir)
    slots = similarity.exploded(signed, ["hash", "seq"])
    found = staged(similarity.best(similarity.candidates(slots, similarity.bases(slots, "seq", 5))), "best")
    parts = None
    for t in (0.7, 0.8, 0.9):
        part = similarity.outcomes(signed, similarity.gate(found, SimilarityConfig(t))).groupBy("outcome").agg(F.count("*").alias("chunks")).select(F.lit(t).alias("threshold"), "outcome", "chunks")
        parts = part if parts is None else parts.unionByName(part)
    return parts


HEAD_SQL = _sql(LARGE) + """, u AS (SELECT hash, any_value(data) AS data, min(doc_id * 16777216 + chunk_no) AS seq FROM c GROUP BY hash),
h AS (SELECT hash, seq, data, min(seq) OVER (PARTITION BY data[1:64]) AS first_seq FROM u)
SELECT h.hash, u.hash AS head_hash, octet_length(h.data) > 64 AND octet_length(u.data) > 64 AND h.data[octet_length(h.data) - 63 :] = u.data[octet_length(u.data) - 63 :] AS same_tail
FROM h JOIN u ON u.seq = h.first_seq WHERE h.seq > h.first_seq"""


@query(HEAD_SQL)
def head_tail_filter(spark, sf_dir):
    """Distinct chunks that share their first 64 bytes with an earlier one, and whether the last 64 agree too."""
    unique = staged(_distinct(spark, sf_dir).select("hash", "seq", "data"), "heads")
    firsts = unique.groupBy(F.substring("data", 1, 64).alias("head")).agg(F.min(F.struct("seq", "hash")).alias("top"), F.count("*").alias("n")).where("n > 1").select("head", "top.seq", "top.hash")
    later = unique.withColumn("head", F.substring("data", 1, 64)).join(firsts.toDF("head", "first_seq", "head_hash"), "head").where("seq > first_seq")
    ends = lambda c: F.when(F.octet_length(c) > 64, F.expr(f"substring({c}, octet_length({c}) - 63, 64)"))
    met = later.join(unique.select(F.col("hash").alias("head_hash"), F.col("data").alias("other")), "head_hash")
    return met.where(features.head_tail_similar(F.col("data"), F.col("other"))).select("hash", "head_hash", F.coalesce(ends("data") == ends("other"), F.lit(False)).alias("same_tail"))


# payloads


@query("""
WITH p AS (SELECT 'documents' AS tab, doc_id AS id, encode(coalesce(text, '')) AS b FROM documents UNION ALL SELECT 'pages', page_id, encode(coalesce(html, '')) FROM pages),
x AS (SELECT tab, id, least(1024, octet_length(b)) AS n, hex(b[1:1024]) AS h FROM p),
v AS (SELECT tab, id, n, len(list_distinct([h[2 * i + 1 : 2 * i + 2] FOR i IN range(0, n)])) AS distinct_bytes FROM x)
SELECT tab AS "table", id, CAST(distinct_bytes AS INT) AS distinct_bytes, n >= 256 AND distinct_bytes > 220 AS high_entropy FROM v""")
def high_entropy_flag(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.lit("documents").alias("table"), F.col("doc_id").alias("id"), "content")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("table"), F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    both = docs.unionByName(pages)
    return both.select("table", "id", codec.distinct_bytes(F.col("content")).alias("distinct_bytes"), codec.high_entropy(F.col("content")).alias("high_entropy"))


@query(SIGNED_SQL + """SELECT tier, least(q.length, b.length) >= 256 AND greatest(q.length, b.length) <= 4 * least(q.length, b.length) AS allowed, count(*) AS pairs
FROM best JOIN u q ON best.hash = q.hash JOIN u b ON best.base_hash = b.hash GROUP BY 1, 2""")
def delta_gate_size_ratio(spark, sf_dir):
    signed = _signed(spark, sf_dir)
    slots = similarity.exploded(signed, ["hash", "seq"])
    found = similarity.best(similarity.candidates(slots, similarity.bases(slots, "seq", 5)))
    sizes = signed.select("hash", "length")
    met = found.join(sizes, "hash").join(sizes.toDF("base_hash", "base_length"), "base_hash")
    return met.groupBy("tier", codec.delta_gate(F.col("length"), F.col("base_length")).alias("allowed")).agg(F.count("*").alias("pairs"))


# content-defined chunks, other hashes and codecs: what must hold of them


def _cdc(spark, sf_dir, config: ChunkConfig) -> DataFrame:
    return hashed(cdc_chunks(_docs(spark, sf_dir), config, key="doc_id"))


def _joined(parts: DataFrame, data: str = "data") -> DataFrame:
    """doc_id, digest of its chunks' bytes in their order."""
    whole = parts.groupBy("doc_id").agg(manifest.ordered(F.hex(data), F.col("chunk_no")).alias("parts"))
    return whole.select("doc_id", F.sha2(F.unhex(F.array_join("parts", "")), 256).alias("digest"))


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, true AS contiguous, true AS within_bounds, sha256(text) AS digest FROM documents WHERE text <> ''")
def cdc_chunks_text(spark, sf_dir):
    """By document: its content-defined chunks follow each other, keep the size bounds, and join to its bytes."""
    chunks = staged(cdc_chunks(_docs(spark, sf_dir), TEXT, key="doc_id"), "cdc-chunks")
    around = Window.partitionBy("doc_id").orderBy("chunk_no")
    placed = chunks.select("doc_id", "chunk_no", "offset", "length", F.lead("offset").over(around).alias("next"))
    end = F.col("offset") + F.col("length")
    fits = (F.col("length") <= TEXT.max_size) & (F.col("length") > 0) & (F.col("next").isNull() | (F.col("length") >= TEXT.min_size))
    report = placed.groupBy("doc_id").agg(F.sum(F.col("length").cast("long")).alias("n_bytes"), (F.bool_and(F.coalesce(F.col("next"), end) == end) & (F.min("offset") == 0)).alias("contiguous"), F.bool_and(fits).alias("within_bounds"))
    return report.join(_joined(chunks), "doc_id")


@query("""SELECT doc_id, octet_length(encode(text)) AS source_bytes, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN NULL ELSE 0 END AS copy_stored_bytes
FROM documents WHERE text <> ''""")
def cdc_dedup_stats(spark, sf_dir):
    """By document: bytes cut, and for copies of an earlier document the bytes of chunks that it brought in."""
    docs = _docs(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("text_hash"))
    first = docs.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"))
    stats = dedup.dedup_stats(_cdc(spark, sf_dir, FINE).select("doc_id", "chunk_no", "length", "hash"), "doc_id", ["doc_id", "chunk_no"])
    copies = docs.join(first, "text_hash").where("doc_id <> first_id").select("doc_id", F.lit(True).alias("copy"))
    return stats.join(copies, "doc_id", "left").select("doc_id", "source_bytes", F.when(F.col("copy"), F.col("stored_bytes")).cast("int").alias("copy_stored_bytes"))


@query(_sql(MIDDLE) + "SELECT doc_id, chunk_no, length, min(doc_id * 16777216 + chunk_no) OVER (PARTITION BY data) AS first_seq FROM c")
def blake3_chunk_hashes(spark, sf_dir):
    """By chunk: the first chunk with its BLAKE3 hash."""
    chunks = hashed(fixed_chunks(_docs(spark, sf_dir), MIDDLE, keep=["doc_id"]), "blake3").select("doc_id", "chunk_no", "length", "hash", (F.col("doc_id") * SEQ + F.col("chunk_no")).alias("seq"))
    chunks = staged(chunks, "blake3-chunks")
    return chunks.join(chunks.groupBy("hash").agg(F.min("seq").alias("first_seq")), "hash").select("doc_id", "chunk_no", "length", "first_seq")


@query(SIGNED_SQL + "SELECT tier, slot, count(*) AS chunks, min(seq) AS first_seq FROM k GROUP BY tier, slot, sf HAVING count(*) > 1")
def xxh3_signatures(spark, sf_dir):
    """The buckets that chunks share by their xxh3 super-features."""
    slots = similarity.exploded(features.with_keys(_distinct(spark, sf_dir)), ["hash", "seq"])
    return slots.groupBy("tier", "slot", "sf").agg(F.count("*").alias("chunks"), F.min("seq").alias("first_seq")).where("chunks > 1").drop("sf")


@query("SELECT doc_id, sha256(text) AS digest, true AS no_larger FROM documents WHERE text <> ''")
def payload_choice(spark, sf_dir):
    """By document: the digest of what its chunks' payloads decode to, and whether no payload outgrew its chunk."""
    chunks = cdc_chunks(_docs(spark, sf_dir), TEXT, key="doc_id")
    coded = staged(chunks.select("doc_id", "chunk_no", "length", codec.payload_column(F.col("data")).alias("p")), "payloads")
    back = codec.decoded_column(F.col("p.entry_type"), F.col("p.payload"), F.lit(None).cast("binary"), F.col("length"))
    sizes = coded.groupBy("doc_id").agg(F.bool_and(F.col("p.stored_length") <= F.col("length")).alias("no_larger"))
    return _joined(coded.select("doc_id", "chunk_no", back.alias("back")), "back").join(sizes, "doc_id")


@query()
def sequential_near_dups(spark, sf_dir):
    chunks = _cdc(spark, sf_dir, FINE).withColumn("seq", F.col("doc_id") * SEQ + F.col("chunk_no"))
    unique = chunks.groupBy("hash").agg(F.min("seq").alias("seq"), F.first("data").alias("data"))
    return similarity.sequential_matches(features.with_keys(unique))


@query(SIGNED_SQL + """SELECT best.hash, base_hash, tier, least(q.length, b.length) >= 256 AND greatest(q.length, b.length) <= 4 * least(q.length, b.length) AS allowed, best.hash AS restored
FROM best JOIN u q ON best.hash = q.hash JOIN u b ON best.base_hash = b.hash""")
def delta_encode_stats(spark, sf_dir):
    """Chunks coded against their best match: the hash of what the payload decodes to, and whether a delta was allowed."""
    unique = _distinct(spark, sf_dir)
    slots = similarity.exploded(unique.select("hash", "seq", features.sql_keys(features.sql_features(F.col("data")), F.col("length")).alias("keys")), ["hash", "seq"])
    found = staged(similarity.best(similarity.candidates(slots, similarity.bases(slots, "seq", 5))).select("hash", "base_hash", "tier"), "delta-pairs")
    met = found.join(unique.select("hash", "data"), "hash").join(unique.select(F.col("hash").alias("base_hash"), F.col("data").alias("base")), "base_hash")
    n = F.octet_length("data")
    coded = met.select("hash", "base_hash", "tier", n.alias("n"), "base", codec.delta_gate(n, F.octet_length("base")).alias("allowed"), codec.payload_column(F.col("data"), F.col("base")).alias("p"))
    back = codec.decoded_column(F.col("p.entry_type"), F.col("p.payload"), F.when(F.col("p.entry_type") == codec.DELTA, F.col("base")), F.col("n"))
    return staged(coded, "deltas").select("hash", "base_hash", "tier", "allowed", F.sha2(back, 256).alias("restored"))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, true AS same FROM documents")
def backup_restore_roundtrip(spark, sf_dir):
    """Back all documents up, restore them, compare; by document: same."""
    from sediment.plans.backup import backup, restored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = from_table(docs, "doc_id", "text")
    store = ChunkStore(spark, scratch_path(spark, "store"))
    backup(files, store, BackupOptions(chunks=FINE))
    back = restored(store)
    return files.select("name", F.sha2("content", 256).alias("was")).join(back.select("name", F.sha2("content", 256).alias("now"), "complete"), "name", "left").select("name", (F.coalesce(F.col("was") == F.col("now"), F.lit(False)) & F.col("complete")).alias("same"))
