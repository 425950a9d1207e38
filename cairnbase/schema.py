"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "files": "id long, content_hash string, path string, filename string, format string, mime string, byte_size long, created_at timestamp, updated_at timestamp",
    "jobs": "id long, content_hash string, stage string, input_hash string, status string, model_version string, params map<string,string>, error string, started_at timestamp, finished_at timestamp",
    "chapters": "id long, file_id long, parent_id long, level int, ord int, title string, page_start int, page_end int, source string",
    "chunks": "id long, file_id long, chapter_id long, page int, ord int, text string, char_count int",
    "links": "id long, file_id long, kind string, src_page int, dst_page int, src_chapter_id long, dst_chapter_id long, target_label string, score double",
    "relations": "id long, kind string, src_chapter_id long, src_image_id long, dst_chapter_id long, src_file_id long, dst_file_id long, score double",
    "figures": "id long, file_id long, page int, kind string, ord int, bbox struct<x0:double,y0:double,x1:double,y1:double>, width int, height int, image_path string, table_md string, caption string, vlm_description string, ocr_text string",
    "entities": "id long, name string, type string, norm_key string, aliases array<string>, acronyms array<string>, wiki_path string, slug string, status string, source_count int",
    "wiki_pages": "id long, path string, title string, kind string, entity_id long, source_count int, last_synth_at timestamp, md_hash string",
    "claims": "id long, entity_id long, wiki_page_id long, file_id long, text string, status string, confidence double, created_at timestamp",
    "claim_sources": "id long, claim_id long, chunk_id long, file_id long",
    "mentions": "id long, file_id long, chunk_id long, entity_id long, score double, decision string, signals struct<alias:double,lexical:double,embed:double,comention:double>",
    "entity_review": "id long, mention_surface string, mention_type string, file_id long, entity_id long, payload string, llm_verdict string, human_verdict string, state string",
    "entity_merges": "id long, from_id long, into_id long, reason string, committed_sha string, moved struct<claims:array<long>,mentions:array<long>,aliases_added:array<string>,acronyms_added:array<string>,renamed_from:string,prior_status:string,prior_name:string>",
    "images": "id long, file_id long, width int, height int, vlm_description string, ocr_text string, exif_datetime timestamp, gps_lat double, gps_lon double, geo_country string, geo_place string, is_floorplan boolean, cluster_id long",
    "vec_text": "chunk_id long, file_id long, chapter_id long, page int, vector array<float>",
    "vec_images": "file_id long, format string, byte_size long, geo_country string, exif_ts long, vector array<float>",
    "vec_captions": "file_id long, vector array<float>",
    "vec_entities": "entity_id long, type string, vector array<float>",
}

TABLES = tuple(_DDL)


def schema(table: str) -> StructType:
    """Schema of a table; parsed when asked for, which needs a session."""
    return StructType.fromDDL(_DDL[table])
