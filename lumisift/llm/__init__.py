"""Operators for preparing training text: deduplication, mixing, packing, language and licence labels.

Nothing outside this subpackage imports it.
"""
