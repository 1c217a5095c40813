"""Registry of the subpackage's queries and the SQL they are checked against."""

from __future__ import annotations

from threadloom.llm import label_queries, leak_queries, native_queries, near_queries, page_queries, suffix_queries, token_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _module in (label_queries, leak_queries, native_queries, near_queries, page_queries, suffix_queries, token_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
