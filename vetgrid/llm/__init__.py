"""Operators for training-data pipelines, their queries and their SQL.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
