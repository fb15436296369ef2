"""Importing this module registers every query."""

from wardstone.catalog import (  # noqa: F401
    access_queries,
    decision_queries,
    operations_queries,
    question_queries,
    ranking_queries,
    stream_queries,
    structure_queries,
    text_queries,
)
