"""Operators for preparing training data: duplicates, filters, tokenizers, packing, search, personal data.

Nothing outside this subpackage imports it. ``queries.QUERIES`` and ``queries.ORACLES`` hold the named queries.
"""
