"""Operators for preparing text corpora for language-model training.

Every operator selects the columns it needs first, so extra input columns,
also ones whose names clash with internal ones, neither reach nor break it.
Nothing outside this subpackage imports it.
"""
