"""Registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from quillstream.plans import document_oracles, document_queries, input_oracles, input_queries, job_oracles, job_queries, oracles, page_oracles, page_queries
from quillstream.plans.queries import QUERIES

ORACLES = oracles.ORACLES | document_oracles.ORACLES | page_oracles.ORACLES | input_oracles.ORACLES | job_oracles.ORACLES
FLAGSHIP = "invoice_round_trip"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "document_queries", "input_queries", "job_queries", "page_queries"]
