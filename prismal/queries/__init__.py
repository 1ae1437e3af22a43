"""Importing this package fills the registry."""

from prismal.queries import clean_queries, explore_queries, frame_queries, model_queries, neighbour_queries, profile_queries, series_queries, stats_queries  # noqa: F401
from prismal.queries.registry import ORACLE, QUERIES  # noqa: F401
