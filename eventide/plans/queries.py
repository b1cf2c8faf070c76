"""Imports all modules that register queries."""

from . import q_aggregates, q_features, q_fields, q_grid, q_inference, q_joins, q_pooling, q_scoring, q_screens, q_skill, q_suite  # noqa: F401
