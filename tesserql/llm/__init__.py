"""Operators for large-scale training-data preparation.

Nothing else in the package imports this subpackage; its queries are in
:mod:`tesserql.llm.queries`.
"""
