"""Relational operators: search, facets, linkage, deduplication, grouping, ranking, editing."""
