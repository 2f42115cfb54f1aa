"""Scalar functions over file names: folding, extensions, literals, scores, highlights."""
