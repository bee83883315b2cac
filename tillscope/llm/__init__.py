"""Operators of a training-data pipeline: language ID, dedup, packing, tokens, WARC, search.

Nothing else in the library imports this subpackage.
"""
