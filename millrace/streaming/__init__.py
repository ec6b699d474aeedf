"""Structured Streaming jobs: bookmarked loads and streaming ETL."""
