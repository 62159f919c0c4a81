"""Schemas of the tables."""

FILES = "name STRING, path STRING, size BIGINT, modified BIGINT, permissions INT, content BINARY"
CHUNKS = "file_id STRING, chunk_no INT, offset BIGINT, length INT, hash STRING, data BINARY"
CHUNK_STORE = "hash STRING, pack_id BIGINT, entry_type STRING, base_hash STRING, payload BINARY, orig_length INT, stored_length INT, keys ARRAY<STRUCT<tier: INT, slot: INT, sf: BIGINT>>, ingest_id STRING, seq BIGINT"
MANIFESTS = "name STRING, path STRING, size BIGINT, modified BIGINT, permissions INT, chunk_hashes ARRAY<STRING>, ingest_id STRING"
