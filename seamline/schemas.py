"""Schemas of the store's tables."""

from __future__ import annotations

FILES = "codebase string, path string, text string"
CHUNKS = "codebase string, id string, symbol_name string, path string, line_start int, line_end int, created_at timestamp"
VECTORS = "codebase string, id string, norm float, codes binary"
GRAPH = "codebase string, file_path string, kind string, name string, callee string, start_line int, end_line int"
FILE_STATE = "codebase string, path string, file_hash string, text_hash string"
CODEBASES = "codebase string, root_hash string, updated_at timestamp"
TABLES = {"files": FILES, "chunks": CHUNKS, "vectors": VECTORS, "graph": GRAPH, "file_state": FILE_STATE, "codebases": CODEBASES}
