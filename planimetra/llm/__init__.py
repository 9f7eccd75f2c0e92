"""Operators for large training corpora: deduplication, filtering, scoring and mixing.

Nothing else in the library imports this subpackage.
"""
