"""Operators for building training data: near duplicates, contamination, shards, packing and scoring.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL.
"""
