"""Schemas of the entities that come as JSON or CSV."""

CONTROLS = """control_family struct<number: string, name: string>, control_subfamily struct<number: string, name: string>,
control struct<id: string, name: string, description: string, implementation_guidelines: string, sub_controls: array<string>, guidance_points: array<string>, internal_factors: array<string>, external_factors: array<string>, full_text: string>,
applicability array<string>, breadcrumb string, validation_status string, enrichment_sources array<string>, has_useful_text boolean, full_text_length int, source_row_count int"""
PASSAGES = "id string, name string, text string, section string, metadata map<string, string>"
MAPPINGS = "mapping_id string, source_control_id string, target_policy_id string, status string, entailment_score double, evidence_text string, mapping_date string, reviewer string, notes string"
LABELS = """control_id string, original_control_id string, corrected_control_id string, control_name string, policy_passage_id string, policy_name string, policy_section string, compliance_status string,
confidence int, mismatch_reason string, is_hard_negative boolean, evidence_or_notes string, comments string, control_text_snippet string, policy_text_snippet string"""
ROUTING = "document_id string, title string, routed_families array<string>, confidence array<double>, method string"
FAMILIES = "map<string, struct<name: string, type: string, description: string, policy_document_types: array<string>, keywords: array<string>>>"
EXPORT = "data map<string, string>, annotations array<struct<result: array<struct<from_name: string, value: struct<text: array<string>, choices: array<string>, taxonomy: array<array<string>>>>>>>"
