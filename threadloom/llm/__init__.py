"""Operators for preparing training corpora: dedup, filters, mixing, counting and encoding.

Nothing else in the library imports this subpackage.
"""
