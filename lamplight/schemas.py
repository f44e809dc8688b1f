"""Schemas of the stored tables and of the nested document model, as DDL."""

from __future__ import annotations

BOX = "struct<x_min: double, y_min: double, x_max: double, y_max: double>"

CITATIONS = "array<struct<page: int, bbox: array<double>>>"

BLOCK = f"struct<type: string, content: string, reading_order: int, page_number: int, bbox: {BOX}>"

PACKED = (
    "struct<content: string, block_types: array<string>, section_title: string, page_number: int,"
    f" bboxes: {CITATIONS}, piece: int>"
)

CHUNK_METADATA = (
    f"struct<section_title: string, block_types: array<string>, bboxes: {CITATIONS},"
    " language: string, extractor: string>"
)

CHANNELS = "id string, name string, description string, metadata map<string,string>, created_at timestamp"

REPORTS = (
    "id string, channel_id string, filename string, title string,"
    " metadata map<string,string>, created_at timestamp"
)

CHUNKS = (
    "id string, channel_id string, report_id string, page_number int, chunk_index int, content string,"
    f" embedding array<float>, sparse_embedding map<int,float>, metadata {CHUNK_METADATA},"
    " created_at timestamp, report_bucket int"
)

JOBS = (
    "id string, status string, output_data string, error_message string,"
    " started_at timestamp, completed_at timestamp, created_at timestamp"
)

TENANTS = (
    "channelid int, name string, rag_channel_id string, metadata map<string,string>,"
    " authorized_features array<string>"
)

# No password column: callers prove identity elsewhere and hand in a digest.
USERS = (
    "userid int, name string, username string, credential_digest string, channelid int,"
    " authorized_features array<string>, authorized_data map<string,string>"
)

SESSIONS = (
    "session_id string, user_id int, ip_address string, login_at timestamp,"
    " expires_at timestamp, ended_at timestamp"
)

MIGRATIONS = "version string, applied_at timestamp"

TABLES = {
    "channels": CHANNELS,
    "reports": REPORTS,
    "report_chunks": CHUNKS,
    "ai_jobs": JOBS,
    "tenants": TENANTS,
    "users": USERS,
    "sessions": SESSIONS,
    "schema_migrations": MIGRATIONS,
}

# Natural keys that must stay unique, and the directory layout of each table.
UNIQUE_KEYS = {
    "channels": [["id"], ["name"]],
    "reports": [["id"], ["channel_id", "filename"]],
    "report_chunks": [["report_id", "page_number", "chunk_index"]],
    "tenants": [["channelid"], ["name"]],
    "users": [["userid"], ["username"]],
}

PARTITIONS = {
    "reports": ["channel_id"],
    "report_chunks": ["channel_id", "report_bucket"],
}

RESULT = (
    "id string, channel_id string, report_id string, page_number int, chunk_index int, content string,"
    f" metadata {CHUNK_METADATA}, rrf_score double, rerank_score double, is_neighbour boolean,"
    " neighbour_of string, primary_rank int, position int"
)
