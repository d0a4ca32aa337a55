"""Operators of a training-data pipeline: cleaning, deduplication, tokens, packing, archives and sharding.

Nothing outside this folder and `corpus_pipeline.py` imports it.
"""
