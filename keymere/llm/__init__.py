"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; the queries that apply the operators
to whole tables are in :mod:`keymere.llm.queries`.
"""
