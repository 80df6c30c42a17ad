"""Operators for preparing large text corpora and vector sets.

Nothing else in the library imports this subpackage; its queries are listed
in :mod:`wordloom.llm.queries`.
"""
