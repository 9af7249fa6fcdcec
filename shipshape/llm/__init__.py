"""Operators of a training-data pipeline: thirteen operators, their registered queries and SQL twins.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
