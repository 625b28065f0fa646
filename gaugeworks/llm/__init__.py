"""Operators of a training-data pipeline over crawled pages and documents."""
