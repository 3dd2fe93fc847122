"""All queries of the library's own operators and their SQL."""

from . import queries_match, queries_stages, queries_text

QUERIES: dict = queries_text.QUERIES | queries_match.QUERIES | queries_stages.QUERIES
ORACLE_SQL: dict = queries_text.ORACLE_SQL | queries_match.ORACLE_SQL | queries_stages.ORACLE_SQL
