"""The derived tables' columns. Every table can be rebuilt from the notes' files."""

from __future__ import annotations

FILES = "path string, content binary, size long, mtime long"
NOTES = "path string, type string, title string, description string, created string, updated string, body_hash string, mtime long, aliases array<string>, tags array<string>, relations array<string>, body string, readable boolean"
CHUNKS = "note_path string, seq int, char_start int, char_end int, token_count int, heading_path string, text string, text_hash string"
RESOURCES = "path string, class string, size long, mtime long, content_hash string"
EDGES = "id string, src_path string, dst_path string, dst_resource_path string, dst_path_raw string, type string, origin string, explanation string, embed boolean, caption string, occurrence_index int"
EMBEDDINGS = "text_hash string, vector array<float>"
CENTROIDS = "note_path string, centroid array<float>"
POSTINGS = "term string, note_path string, seq int, tf int"
DOC_STATS = "note_path string, seq int, dl int"

#: Part of every version folder's name: another layout of the tables is another folder.
VERSION = "v2"

#: What a table lies in buckets by.
KEYS = {"notes": "path", "chunks": "note_path", "resources": "path", "edges": "src_path", "postings": "note_path", "doc_stats": "note_path", "embeddings": "text_hash", "note_centroids": "note_path"}
