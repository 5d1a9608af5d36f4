"""Operators for preparing training text: deduplication, scoring, mixing, tokenising.

Every operator takes and returns DataFrames. Nothing outside this subpackage imports it.
"""
