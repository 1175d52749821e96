"""Cohort, transcript and evaluation analytics as PySpark DataFrame operators."""
