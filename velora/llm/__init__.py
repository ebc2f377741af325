"""Operators that prepare text for language-model training.

Nothing else in the library imports this subpackage; its queries and their SQL
are in :mod:`velora.llm.queries`.
"""
