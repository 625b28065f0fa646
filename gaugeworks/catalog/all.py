"""Imports every query module, which registers its queries."""

import importlib

MODULES = [
    "text_queries",
    "sample_queries",
    "metric_queries",
    "plan_queries",
    "retrieval_queries",
    "rule_queries",
    "source_queries",
    "stream_queries",
]

for _name in MODULES:
    importlib.import_module(f"gaugeworks.catalog.{_name}")
