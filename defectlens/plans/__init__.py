"""Registered queries: each operator run over the whole driver tables, with its SQL twin."""

from __future__ import annotations

from . import (
    code_queries, corpus_queries, evaluation_queries, learning_queries, table_queries,
    text_queries,
)
from .registry import oracles, registered

__all__ = ["registered", "oracles"]
