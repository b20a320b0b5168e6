"""Operators for building training data at large scale, and the queries that apply them.

Nothing outside this folder imports it, apart from ``__spark_entry__.py`` (guarded) and
``corpus_pipeline.py``.
"""
