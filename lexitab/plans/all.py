"""Importing this module registers every query."""

from lexitab.plans import gain_queries, metric_queries, provider_queries, source_queries, store_queries, study_queries, text_queries, vector_queries  # noqa: F401
