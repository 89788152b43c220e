"""Registered queries: importing a query module fills the registry."""

from . import base, climate_queries, metric_queries, model_queries, series_queries, space_queries, stream_queries, text_queries  # noqa: F401
