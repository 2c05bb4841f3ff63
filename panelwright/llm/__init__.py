"""Operators for preparing training corpora: filters, near duplicates, sharding, packing, scoring, search.

Nothing outside this subpackage and `corpus_pipeline.py` imports it.
"""
