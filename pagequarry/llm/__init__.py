"""Training-data operators: search, tokens, quality, near-duplicates, packing, licences, shards.

Nothing outside this subpackage imports it.
"""
