"""All queries of this folder, and SQL for those that SQL can say."""

from __future__ import annotations

from tidemark.llm import abuse, chunking, conversations, mixing, packing, redaction_queries, truncation

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (redaction_queries, truncation, chunking, conversations, packing, mixing, abuse):
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
