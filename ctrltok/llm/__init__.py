"""Operators for training-data pipelines over a ``documents`` table.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
