"""Structured Streaming forms of the report and of sample ingestion."""
