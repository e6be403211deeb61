"""Runnable cases over the sample tables: a Spark query each, and its SQL answer."""

from __future__ import annotations


def load_cases():
    """All registered cases by name."""
    from gradloom.suite import base, batches, examples, optimizers, ranking, sources, transport, vectors  # noqa: F401

    return dict(base.CASES)
