"""Operators for preparing language-model training data (documents, pages, benchmark, labels).

Nothing outside this package imports it; queries are listed in ``queries.py``."""
