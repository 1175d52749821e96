"""Imports the modules that register queries."""

from vocalith.plans import cohort_queries, frame_queries, io_queries, score_queries, transcript_queries  # noqa: F401
