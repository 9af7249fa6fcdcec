"""Logical plans of the star schema (staging, dimensions, facts)."""
