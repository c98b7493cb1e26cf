"""Imports every query module so the registry is complete."""

from . import q_corpus, q_detect, q_eval, q_mask, q_ml, q_models, q_notes, q_profile, q_spans, q_tokens  # noqa: F401
from . import q_sources, q_stream  # noqa: F401  (after the others: reuse their oracles)
from .registry import REGISTRY, TABLES  # noqa: F401


def queries():
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
