"""Operators for large training-text corpora.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; the thin query of each operator is in :mod:`tabularium.llm.queries`.
"""
