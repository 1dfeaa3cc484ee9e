"""The catalogue queries and their SQL, by name."""

from __future__ import annotations

from marlstone.plans import aggregates, curated, curation, extracted, filters, groups, invariants, joins, near_vectors, ranking, resumed, scans, searching, similarity, tagging  # noqa: F401
from marlstone.plans.catalog import QUERIES, SQL

FLAGSHIP = "search_facets_synonyms"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
