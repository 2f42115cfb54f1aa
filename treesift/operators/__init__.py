"""Relational operators: ingest, tree, search, run history, differences."""
