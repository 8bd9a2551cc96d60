"""Operators for training-data pipelines.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.  Every
operator takes DataFrames and column names and returns a DataFrame; the
registered queries over the driver tables are in ``queries.py``.
"""
