"""Explicit schemas of the entities that operators exchange (names and types are the data model's)."""

from __future__ import annotations

from pyspark.sql import types as T

ORGANIZATIONS = "id string, code string, name string, org_type string, parent_id string, is_active boolean"
USERS = "id string, email string, organization_id string, role_codes array<string>"
DOCUMENTS = "id string, organization_id string, title string, document_type string, source_tier string, original_filename string, mime_type string, file_size_bytes long, sha256_hash string, status string, created_at timestamp_ntz"
PAGES = "id string, document_id string, page_number int, text string, confidence double"
TABLES = "document_id string, page_number int, table_index int, caption string, headers array<string>, rows array<array<string>>, row_pages array<int>, logical_table_id string, is_continuation boolean, part_number int, total_parts int, continuation_status string, continuation_confidence double"
CHUNKS = "id string, document_id string, chunk_index int, page_number int, chunk_type string, content string, section_heading string, metadata map<string,string>"
EMBEDDINGS = "id string, chunk_id string, model_name string, dimensions int, embedding_version string, vector array<float>"
FACTS = "id string, organization_id string, document_id string, field_name string, field_category string, data_type string, raw_value string, normalized_value string, numeric_value double, unit string, page_number int, source_text string, extraction_method string, confidence_score double, confidence_level string, validation_status string, reconciliation_status string, verification_status string, metadata map<string,string>"
VALIDATIONS = "field_id string, rule_name string, rule_category string, status string, severity string, message string, observed_value string, expected_constraint string"
CONFLICTS = "id string, organization_id string, entity_name string, metric_name string, reporting_period string, conflict_status string, resolution_status string"
STRATA = "document_id string, borehole_id string, stratum_order int, depth_from_m double, depth_to_m double, thickness_m double, stated_thickness_m double, lithology_type string, raw_lithology string, seam_name string, page_number int, has_thickness_discrepancy boolean, confidence_score double, source_text string"
TRENDS = "topic_id string, period_value string, document_count long, chunk_count long, corpus_document_count long, document_share_pct double, absolute_change long, percentage_point_change double, growth_rate_pct double, trend_status string"
EDGES = "source_document_id string, target_document_id string, relationship_type string, confidence double, criteria string"
VISUALS = "id string, document_id string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, caption string, ocr_text string, visual_type string, confidence double, review_status string"
EDITS = "id string, reserve_record_id string, organization_id string, original_numeric_value double, proposed_numeric_value double, unit string, maker_user_id string, created_at timestamp_ntz"
AUDIT = "actor_id string, actor_name string, role_code string, organization_id string, action string, object_type string, object_id string, details map<string,string>, created_at timestamp_ntz"
JOBS = "id string, document_id string, job_type string, status string, progress_pct int, retry_count int, started_at timestamp_ntz, created_at timestamp_ntz"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
