"""Operators of a training-data pipeline: deduplication, filters, language
identification, mixing, token files and packing.

Nothing else in the library imports this subpackage. Each module holds one
operator, or helpers shared by several; ``queries`` and ``oracle`` register
them over the test tables.
"""
