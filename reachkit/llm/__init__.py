"""Operators of a training-data pipeline, each built as Spark jobs over the corpus tables.

Nothing else in the package imports this subpackage; its queries are registered by
``reachkit.llm.catalog`` and added by the entry module only if the subpackage is there.
"""
