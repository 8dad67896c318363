"""All queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from millrace.plans import fuzzy_queries, geometry_queries, neighborhood_queries, portion_queries, ranking_queries, relational_queries, report_queries, retrieval_queries, scalar_queries, stage_queries, staged_queries, upkeep_queries, vector_queries

FLAGSHIP = "p7_recipe_nutrients"
_MODULES = (relational_queries, report_queries, ranking_queries, scalar_queries, vector_queries, neighborhood_queries, retrieval_queries, geometry_queries, upkeep_queries, stage_queries, portion_queries, fuzzy_queries, staged_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
