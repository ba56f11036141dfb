"""Declared schemas of the stored tables, and the values of their enumerations. Nothing is inferred."""

from __future__ import annotations

# Tables as Spark DDL.
TABLES = {
    "jurisdiction": "code string, name string, type string, iso_alpha2 string, map_feature_id string, default_language string, is_active boolean",
    "court": "id bigint, jurisdiction_code string, source_identifier string, name string, level string, domain string, source_type string, abbreviation string, source_url string, is_active boolean, source_metadata string",
    "case": "id bigint, jurisdiction_code string, source_id string, source_system string, court_id bigint, title string, abstract string, decision_date date, filing_date date, publication_date date, case_numbers array<string>, language string, law_domain string, law_subfield string, procedure_type string, outcome string, source_url string, content_hash string, revision int, first_seen_at timestamp, last_seen_at timestamp, updated_at timestamp, source_metadata string, is_published boolean, filter_score double, needs_review boolean",
    "case_document": "id bigint, case_id bigint, language string, doc_type string, format string, full_text string, raw_payload string, source_url string, content_hash string, byte_size int, retrieved_at timestamp, source_metadata string",
    "party": "id bigint, case_id bigint, name string, role string, party_type string, ordinal int",
    "topic": "id bigint, slug string, label string, description string, parent_id bigint, is_active boolean",
    "case_topic": "case_id bigint, topic_id bigint, confidence double, assigned_by string, assigned_at timestamp",
    "keyword_match": "id bigint, case_id bigint, term_id string, term string, list_version string, field string, weight_applied double, match_count int, snippet string, created_at timestamp",
    "citation": "id bigint, case_id bigint, target_identifier string, target_scheme string, citation_type string, target_title string, target_url string",
    "case_review": "id bigint, case_id bigint, status string, score double, min_score double, band_ceiling double, list_version string, reason string, flagged_at timestamp, flagged_revision int, flagged_content_hash string, decision string, decided_by string, decided_at timestamp, decided_revision int, decision_note string, suppressed_publication boolean",
    "case_review_decision": "id bigint, review_id bigint, decision string, decided_by string, decided_at timestamp, note string, case_revision int, content_hash string",
    "ingest_checkpoint": "connector string, jurisdiction_code string, last_modified_seen timestamp, last_cursor string, last_source_id string, updated_at timestamp",
    "subscriber": "id bigint, email string, email_digest string, status string, token_seed string, created_at timestamp, updated_at timestamp, notice_sent_at timestamp, confirmed_at timestamp, unsubscribed_at timestamp, last_digest_at timestamp, digest_count int",
}
#: Keys that are unique, and references: column to table and its key.
KEYS = {"jurisdiction": ["code"], "court": ["jurisdiction_code", "source_identifier"], "case": ["jurisdiction_code", "source_id"], "topic": ["slug"], "case_topic": ["case_id", "topic_id"], "citation": ["case_id", "target_identifier", "citation_type"], "case_review": ["case_id"], "ingest_checkpoint": ["connector"], "subscriber": ["email"]}
REFERENCES = {"court": {"jurisdiction_code": ("jurisdiction", "code")}, "case": {"jurisdiction_code": ("jurisdiction", "code"), "court_id": ("court", "id")}, "case_document": {"case_id": ("case", "id")}, "party": {"case_id": ("case", "id")}, "citation": {"case_id": ("case", "id")}, "case_review": {"case_id": ("case", "id")}}
VALUES = {
    ("case_review", "status"): ["pending", "decided", "withdrawn"],
    ("case_review", "decision"): ["confirmed", "rejected"],
    ("subscriber", "status"): ["pending", "confirmed", "unsubscribed"],
}
