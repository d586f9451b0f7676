"""Surrogate views over the test tables, the registered queries and their DuckDB counterparts."""

import importlib

TOPICS = ("q_predictions", "q_cohort", "q_vectors", "q_dataset", "q_correction", "q_models", "q_sources")


def load():
    """Import every topic module and return the registry they filled."""
    for topic in TOPICS:
        importlib.import_module(f"catalog.{topic}")
    return importlib.import_module("catalog.registry")
