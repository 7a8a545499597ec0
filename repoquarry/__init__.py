"""Repository-corpus analytics on PySpark: DataFrame-in, DataFrame-out operators."""

from repoquarry.functions.licences import classify_license, is_permissive
from repoquarry.operators.catalogue import build_registry, get_entry, list_entries, search, search_batch
from repoquarry.operators.documents import merge_managed, render_assets, run_summary
from repoquarry.operators.hierarchy import handoff_documents, handoff_edges
from repoquarry.operators.licensing import license_gate, metadata_gate, resolve_license
from repoquarry.operators.profile import detect_framework, detect_language, domains, merge_states, profile_of_state
from repoquarry.operators.profile import repo_profile, repository_state, source_dirs
from repoquarry.operators.quality import rollup, validate_assets
from repoquarry.operators.responses import extract_tools, flatten_agents, parse_responses
from repoquarry.operators.sampling import first_paths, priority_files, sample_files
from repoquarry.operators.search_index import read_index, search_indexed, write_index
from repoquarry.operators.sessions import assemble_sessions
from repoquarry.plans.analyse import analyse_local, analyse_remote, gated
from repoquarry.plans.prompts import local_prompts, remote_prompts
from repoquarry.plans.storage import StageStore
from repoquarry.sources.assets import read_assets, upsert_assets, write_assets
from repoquarry.sources.files import inventory, scan_repositories
from repoquarry.streaming.sessions import stream_sessions

__all__ = [
    "StageStore", "analyse_local", "analyse_remote", "assemble_sessions", "build_registry", "classify_license",
    "detect_framework", "detect_language", "domains", "extract_tools", "first_paths", "flatten_agents", "gated",
    "get_entry", "handoff_documents", "handoff_edges", "inventory", "is_permissive", "license_gate",
    "list_entries", "local_prompts", "merge_managed", "merge_states", "metadata_gate", "parse_responses", "priority_files",
    "read_assets", "read_index", "remote_prompts", "render_assets", "profile_of_state", "repo_profile", "repository_state", "resolve_license", "rollup",
    "run_summary", "sample_files", "scan_repositories", "search", "search_batch", "search_indexed",
    "source_dirs", "stream_sessions", "upsert_assets", "validate_assets", "write_assets", "write_index",
]
