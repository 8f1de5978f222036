"""Schemas, as DDL, of the tables that operators exchange."""

from __future__ import annotations

CHUNKS = (
    "chunk_id string, content string, embedding array<float>, source_file string, ticker string, cik string, company_name string, "
    "filing_type string, filing_date string, section_id string, section_name string, department string, access_roles array<string>, "
    "ingested_at timestamp, chunking_strategy string, chunk_index int, char_count int, table_context boolean"
)
METADATA = [n for n in (part.split()[0] for part in CHUNKS.split(", ")) if n not in ("content", "embedding")]
AUDIT = "event_type string, timestamp timestamp, username string, user_id long, user_roles array<string>, query string, documents_accessed int, response_length int"
QUESTIONS = "question string, ground_truth string, department string, source_filing string, access_roles array<string>, question_type string, expected_behavior string"
