"""Schemas of the graph's tables."""

from __future__ import annotations

NODE_METADATA = """struct<complexity:int, returns:string, dup:string, taint_source:string, taint_flow:boolean, sink_params:array<int>,
    taint_out:array<struct<callee:string,method:int,arg:int,param:int,src:int>>, accessor:boolean, helper:boolean, modifier:string,
    role:boolean, cpan:boolean, verb:string, path:string, framework:string, attrs:array<string>, provenance:string>"""
EDGE_METADATA = "struct<via:string, name:string, module:string, symbols:array<string>, modifier:string, sink:string, dynamic:boolean>"
CANDIDATES = """struct<receiver:string, invocant:boolean, receiver_type:string, receiver_call:string,
    chain:struct<method:string, base_self:boolean, base_type:string, base_func:string>>"""

FILES = "path string, hash string, mtime bigint, language string, node_count int, parse_errors string, indexed_at timestamp, extraction_version int"
NODES = f"""id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int,
    start_col int, end_col int, signature string, docstring string, visibility string, is_exported boolean, metadata {NODE_METADATA}"""
EDGES = f"edge_ord bigint, source string, target string, kind string, line int, col int, provenance string, metadata {EDGE_METADATA}"
REFS = f"""ref_ord bigint, from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string,
    candidates {CANDIDATES}"""
RESOLUTIONS = "caller_qname string, method string, receiver string, target_qname string, provenance string"
POSTINGS = "token string, id string, field string, at int, bucket int"
PIECES = "piece string, id string, bucket int"
EMBEDDINGS = "node_id string, dim int, vec array<float>"
COMMITS = "commit_id string, commit_ord bigint, author string, is_merge boolean, file string"
CALL_SITES = "file string, line int, name string, full string, is_method boolean, is_self boolean, argc int"
