"""All registered queries."""

from . import content, corpus, evals, flows, logs, memory, questions, retrieval, routing  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
