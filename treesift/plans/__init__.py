"""Query language: from a query string to Column predicates and an ordered, capped DataFrame."""
