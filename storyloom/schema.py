"""Schemas of the data model: observations of a page, narration, and the tables of the entity store."""

from __future__ import annotations

BOX = "STRUCT<x: INT, y: INT, w: INT, h: INT>"
BLOCK = "STRUCT<text: STRING, bbox: ARRAY<INT>, confidence: DOUBLE, type: STRING>"
PERSON = "STRUCT<name: STRING, description: STRING, action: STRING, emotion: STRING>"
VISUAL = f"STRUCT<characters: ARRAY<{PERSON}>, environment: STRING, actions: ARRAY<STRING>, objects: ARRAY<STRING>, visual_effects: ARRAY<STRING>, important_event: STRING, composition: STRING, story_relevance: STRING, confidence: DOUBLE>"

#: Artifacts of a page, as DDL.
MANIFEST = "page INT, source STRING, panels ARRAY<STRUCT<id: STRING, image: STRING, bbox: ARRAY<INT>, area: INT, confidence: DOUBLE, reading_order: INT>>"
READING_ORDER = "page INT, direction STRING, `order` ARRAY<STRING>, ignored ARRAY<STRING>"
OCR = f"page INT, panel INT, engine STRING, source STRING, combined_text STRING, text_blocks ARRAY<{BLOCK}>"
PANEL = f"panel_id STRING, page INT, reading_order INT, image STRING, bbox ARRAY<INT>, ocr STRUCT<text: STRING, blocks: ARRAY<{BLOCK}>>, visual {VISUAL}, previous_panel STRING, next_panel STRING, scene_id STRING"
SCRIPT = "scene_id STRING, page INT, segments ARRAY<STRUCT<segment_id: STRING, type: STRING, text: STRING, panel_ids: ARRAY<STRING>, estimated_seconds: DOUBLE, visual_intent: STRING, camera: STRING, importance: DOUBLE, speaker: STRING>>"
MEMORY = "kind STRING, key STRING, value STRING, source STRING, page INT, confidence DOUBLE, state STRING, extra MAP<STRING, STRING>, created_at TIMESTAMP, updated_at TIMESTAMP, seen_count INT"

#: The entity store: table -> (DDL, key columns). Lists and open objects are nested types, not JSON in text.
STORE: dict[str, tuple[str, tuple[str, ...]]] = {
    "works": ("work_id STRING, title STRING, alt_titles ARRAY<STRING>, author STRING, genres ARRAY<STRING>, status STRING, synopsis STRING, updated_at TIMESTAMP", ("work_id",)),
    "chapters": ("work_id STRING, pdf_page_start INT, pdf_page_end INT, chapter_number INT, title STRING, confidence DOUBLE, source STRING, extra MAP<STRING, STRING>", ("work_id", "pdf_page_start")),
    "characters": ("work_id STRING, character_id STRING, name STRING, aliases ARRAY<STRING>, role STRING, description STRING, visual_traits MAP<STRING, STRING>, first_page INT, last_page INT, appearance_count INT, confidence DOUBLE, extra MAP<STRING, STRING>", ("work_id", "character_id")),
    "character_aliases": ("work_id STRING, alias STRING, character_id STRING, source STRING", ("work_id", "alias")),
    "relationships": ("work_id STRING, character_a STRING, character_b STRING, relationship STRING, confidence DOUBLE, source STRING", ("work_id", "character_a", "character_b", "relationship")),
    "locations": ("work_id STRING, location_id STRING, name STRING, description STRING, first_page INT, last_page INT, appearance_count INT", ("work_id", "location_id")),
    "organizations": ("work_id STRING, org_id STRING, name STRING, description STRING, members ARRAY<STRING>", ("work_id", "org_id")),
    "abilities": ("work_id STRING, ability_id STRING, name STRING, description STRING, owner STRING", ("work_id", "ability_id")),
    "events": ("work_id STRING, event_id STRING, page_number INT, chapter_id INT, event_type STRING, description STRING, characters ARRAY<STRING>, importance DOUBLE, extra MAP<STRING, STRING>", ("work_id", "event_id")),
    "summaries": ("work_id STRING, summary_id STRING, summary_type STRING, page_number INT, chapter_id INT, short_text STRING, medium_text STRING, important_events ARRAY<STRING>, new_characters ARRAY<STRING>", ("work_id", "summary_id")),
    "source_evidence": ("work_id STRING, evidence_id STRING, entity_type STRING, entity_key STRING, value STRING, source_type STRING, source_url STRING, pdf_page INT, confidence DOUBLE, created_at TIMESTAMP", ("work_id", "evidence_id")),
    "conflicts": ("work_id STRING, conflict_id STRING, entity_type STRING, entity_key STRING, value_a STRING, source_a STRING, value_b STRING, source_b STRING, resolution STRING, resolved_value STRING, resolved_by STRING, created_at TIMESTAMP", ("work_id", "conflict_id")),
    "timeline": ("work_id STRING, entry_id STRING, page_number INT, label STRING, description STRING", ("work_id", "entry_id")),
    "terminology": ("work_id STRING, term STRING, definition STRING, source STRING", ("work_id", "term")),
    "research_cache": ("work_id STRING, query STRING, source_url STRING, result STRING, fetched_at TIMESTAMP", ("work_id", "query", "source_url")),
    "processing_checkpoints": ("work_id STRING, stage STRING, key_value STRING, status STRING, started_at TIMESTAMP, completed_at TIMESTAMP", ("work_id", "stage", "key_value")),
}
