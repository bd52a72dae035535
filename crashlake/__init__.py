"""Crash-corpus triage on Spark: ingest, three-level dedup, rule-based
classification, ranking and roll-ups as DataFrame transformations."""

__version__ = "0.1.0"
