"""Operators for training-data corpora: deduplication, scoring, extraction and mixing.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; ``queries.py`` holds the thin ``opN_<name>`` queries.
"""
