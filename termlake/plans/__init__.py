"""All queries of the library by name, and the SQL that says the same."""

from . import chrony_queries, search_queries, set_queries, value_queries

QUERIES = search_queries.QUERIES | set_queries.QUERIES | chrony_queries.QUERIES | value_queries.QUERIES
ORACLE_SQL = search_queries.ORACLE_SQL | set_queries.ORACLE_SQL | chrony_queries.ORACLE_SQL | value_queries.ORACLE_SQL
