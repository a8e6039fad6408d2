"""Whole dataflows: scoring answers, reports over scores, incremental runs."""
