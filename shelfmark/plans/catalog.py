"""All bound queries; importing the modules registers them."""

from shelfmark.plans import evaluation, ingestion, metric_facts, request_log, retrieval, streams, transcripts  # noqa: F401
from shelfmark.plans.registry import ORACLES, QUERIES  # noqa: F401
