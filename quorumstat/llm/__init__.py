"""Operators for preparing training text: deduplication, filters, scans, packing.

Each module holds one operator; ``queries`` registers one query for each of them and
``corpus_pipeline`` at the top of the repository chains five. Nothing else in the library
imports this package.
"""
