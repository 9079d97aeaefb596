"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage; its queries are listed in
``tessera.llm.queries`` and added to the catalogue only when it is present.
"""
