"""Reviewing large collections of short posts on Spark."""

from siftwell.operators.items import assign_chunks, drop_invalid_ids, resolve_ids, select_chunk
from siftwell.operators.merge import latest_by_key, merge_verdicts
from siftwell.operators.numbering import number_rows
from siftwell.operators.pending import cached_lookup, missing_items, split_pending
from siftwell.operators.report import full_report_lines, report
from siftwell.operators.requests import render_requests
from siftwell.operators.responses import failed, good, parse_responses
from siftwell.operators.scoring import Client, score_rules, score_with_client
from siftwell.operators.stats import run_stats
from siftwell.plans.audit import (
    AuditResult,
    audit_archive,
    client_scorer,
    retry_pending,
    rule_scorer,
    run_audit,
)
from siftwell.plans.merging import merge_report_files, merge_reports, publish_merged
from siftwell.session import build_session
from siftwell.sources.archive import import_archive, scan_archive
from siftwell.sources.ledger import AnswerLedger
from siftwell.sources.responses import scan_responses
from siftwell.sources.store import VerdictStore
from siftwell.spec import AuditSpec, Criteria, UrlSpec, load_spec
from siftwell.streaming.collector import collect_responses

__all__ = [
    "AnswerLedger",
    "AuditResult",
    "AuditSpec",
    "Client",
    "Criteria",
    "UrlSpec",
    "VerdictStore",
    "assign_chunks",
    "audit_archive",
    "build_session",
    "cached_lookup",
    "client_scorer",
    "collect_responses",
    "drop_invalid_ids",
    "failed",
    "full_report_lines",
    "good",
    "import_archive",
    "latest_by_key",
    "load_spec",
    "merge_report_files",
    "merge_reports",
    "merge_verdicts",
    "missing_items",
    "number_rows",
    "parse_responses",
    "publish_merged",
    "render_requests",
    "report",
    "resolve_ids",
    "retry_pending",
    "rule_scorer",
    "run_audit",
    "run_stats",
    "scan_archive",
    "scan_responses",
    "score_rules",
    "score_with_client",
    "select_chunk",
    "split_pending",
]
