"""Operators for building training corpora, one module each, and their queries.

``llm_queries()`` and ``llm_oracles()`` are what ``__spark_entry__`` adds; no
other part of the library imports this subpackage.
"""
