"""Customer feedback to product requests, ranked by the revenue behind them."""

from feedback_rank.operators.extract import assign_chunks, extract_mentions, extract_plugin
from feedback_rank.operators.merge import merge_features, similar_links
from feedback_rank.operators.payload import chunk_status, parse_payload, payload_mentions
from feedback_rank.operators.rollup import feature_rank, rank_features
from feedback_rank.operators.scope import filter_options, scope, scope_totals
from feedback_rank.plans.analyze import analyze, analyze_with
from feedback_rank.plans.history import history_cards, history_detail
from feedback_rank.session import build_session
from feedback_rank.sinks.csv import export_name, write_csv
from feedback_rank.sinks.history import delete_runs, save_run
from feedback_rank.sources.feedback import describe, flatten, read_feedback, read_raw
from feedback_rank.sources.history import load_run_features, load_runs
from feedback_rank.spec import RunSpec

__all__ = [
    "RunSpec", "analyze", "analyze_with", "assign_chunks", "build_session", "chunk_status", "delete_runs",
    "describe", "export_name", "extract_mentions", "extract_plugin", "feature_rank", "filter_options", "flatten",
    "history_cards", "history_detail", "load_run_features", "load_runs", "merge_features", "parse_payload",
    "payload_mentions", "rank_features", "read_feedback", "read_raw", "save_run", "scope", "scope_totals",
    "similar_links", "write_csv",
]
