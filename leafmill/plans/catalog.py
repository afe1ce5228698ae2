"""Imports every module that registers queries."""
from . import extensions, extraction, integrity, questions, ranked, relational, retrieval, sequences, text_rules  # noqa: F401
