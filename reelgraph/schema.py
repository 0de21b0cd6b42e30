"""Table schemas, as DDL, and the closed vocabularies of the data model."""

from __future__ import annotations

# --- fixed values: closed vocabularies of the data model -------------------------------------
ENTITY_TYPES = (
    "PERSON", "OBJECT", "LOCATION", "ACTION", "CONCEPT", "EVENT", "SCENE", "EMOTION", "TIME", "QUANTITY",
)
RELATION_TYPES = (
    "INTERACTS_WITH", "LOCATED_IN", "PERFORMS", "USES", "CONTAINS", "CAUSES", "TEMPORAL_BEFORE",
    "TEMPORAL_AFTER", "SIMILAR_TO", "PART_OF", "OPPOSITE_OF", "ASSOCIATED_WITH",
)
WORKER_STATUSES = ("available", "busy", "offline", "error")
TASK_STATUSES = ("pending", "assigned", "processing", "completed", "failed", "cancelled")
# ----------------------------------------------------------------------------------------------

VIDEOS = (
    "video_id string, video_path string, filename string, duration double, fps double, resolution string, "
    "size_bytes bigint, processing_time double, chunk_count int, frame_count int, created_at double, "
    "updated_at double, success boolean, error_message string"
)
CHUNKS = (
    "chunk_id string, video_id string, start_time double, end_time double, frame_count int, "
    "unified_description string, has_audio boolean, created_at double"
)
FRAMES = (
    "frame_id string, chunk_id string, video_id string, timestamp double, frame_index int, caption string, "
    "confidence double, image_path string, created_at double"
)
AUDIO_SEGMENTS = (
    "segment_id string, chunk_id string, video_id string, start_time double, end_time double, "
    "transcript string, confidence double, audio_path string, created_at double"
)
VECTORS = (
    "entry_id string, vector array<float>, metadata map<string,string>, source_type string, "
    "source_id string, video_id string, timestamp double, created_at double"
)

# A knowledge graph is kept as narrow tables.  Everything set-valued about an entity or relation
# (aliases, source videos, source chunks, appearances, descriptions) is a child table with one row
# per element: a very common entity then means many small rows, never one huge row.
ENTITIES = (
    "graph_id string, entity_id string, name string, entity_type string, description string, confidence double"
)
ALIASES = "graph_id string, entity_id string, alias string"
ENTITY_VIDEOS = "graph_id string, entity_id string, video_id string"
ENTITY_CHUNKS = "graph_id string, entity_id string, chunk_id string"
APPEARANCES = (
    "graph_id string, entity_id string, video_id string, start_time double, end_time double"
)
RELATIONS = (
    "graph_id string, relation_id string, source_entity string, target_entity string, relation_type string, "
    "description string, confidence double, start_time double, end_time double"
)
RELATION_VIDEOS = "graph_id string, relation_id string, video_id string"

MESSAGES = (
    "conversation_id string, seq bigint, role string, content string, timestamp double, confidence double"
)
PROCESSED_VIDEO = (
    "video_id string, video_path string, filename string, duration double, fps double, resolution string, "
    "size_bytes bigint, processing_time double, success boolean, error_message string, "
    "chunks array<struct<chunk_id:string, start_time:double, end_time:double, unified_description:string, "
    "chunk_embedding:array<float>, "
    "frames:array<struct<frame_id:string, timestamp:double, frame_index:int, caption:string, confidence:double, "
    "image_path:string, embedding:array<float>>>, "
    "audio_segment:struct<segment_id:string, start_time:double, end_time:double, transcript:string, "
    "confidence:double, audio_path:string>>>"
)

METADATA_TABLES = {"videos": VIDEOS, "chunks": CHUNKS, "frames": FRAMES, "audio_segments": AUDIO_SEGMENTS}
METADATA_KEYS = {"videos": "video_id", "chunks": "chunk_id", "frames": "frame_id", "audio_segments": "segment_id"}
GRAPH_TABLES = {
    "entities": ENTITIES, "aliases": ALIASES, "entity_videos": ENTITY_VIDEOS, "entity_chunks": ENTITY_CHUNKS,
    "appearances": APPEARANCES, "relations": RELATIONS, "relation_videos": RELATION_VIDEOS,
}
