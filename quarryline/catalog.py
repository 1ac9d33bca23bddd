"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from quarryline.plans import detail_queries, funnel_queries, ledger_queries, report_queries, text_queries

FLAGSHIP = "funnel_counts"
QUERIES = text_queries.QUERIES | funnel_queries.QUERIES  # the report, detail and ledger queries are registered with the funnel's
ORACLE_SQL = text_queries.ORACLE_SQL | funnel_queries.ORACLE_SQL
