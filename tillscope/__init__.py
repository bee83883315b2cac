"""Retail transaction analytics on Spark DataFrames.

Subpackages: ``sources`` (input contracts, readers, sinks, driver-table
fixtures), ``functions`` (column expressions and row filters), ``plans``
(the enriched frame, query registry, oracle statements), ``operators``
(products, brands, payments, stores, demographics) and ``streaming``
(incremental weekly sales over landing item files).
"""
