"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage (and ``corpus_pipeline.py`` at the repository
top) imports it; the rest of the library works without it.
"""
