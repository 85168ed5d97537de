"""Schemas of the catalogue tables as DDL, which needs no session to import; nothing is inferred."""

from __future__ import annotations

LISTING = "path string, folder string, name string, ext string, size bigint, mtime_ns bigint"
FILES = "path string, folder string, name string, ext string, size bigint, mtime_ns bigint, asset_id string, state string, error string, attempts int, present boolean"
ASSETS = (
    "asset_id string, sha256 string, type string, ext string, mime string, size bigint, width int, height int, duration double, pages int, meta map<string,string>, status string, error string, warnings array<string>, "
    "thumb string, pipeline string, created_ts double, indexed_ts double"
)
VECTORS = "vid string, asset_id string, space string, kind string, ref double, text string, thumb string, vector array<float>"
THUMBS = "path string, asset_id string, jpeg binary"
RUNS = "run_id bigint, started_ts double, finished_ts double, status string, summary string"
EVAL_QUERIES = "id string, query string, intent string, expect_types array<string>, relevant_regex string, expected_hint string"
MANIFEST_ENTRY = "struct<title:string,kind:string,tag:string,query:string,categories:array<string>,description:string,license:string,author:string>"
TEXT_INDEX = "bucket int, segment bigint, term string, n int, words bigint, top int, least int, places binary, counts binary, lengths binary, vids array<string>, asset_ids array<string>"
EMPTY = {
    "files": FILES, "assets": ASSETS, "vectors": VECTORS, "thumbs": THUMBS, "runs": RUNS, "text_index": TEXT_INDEX, "text_places": "segment bigint, place int, length bigint", "text_counts": "term string, n bigint",
}
