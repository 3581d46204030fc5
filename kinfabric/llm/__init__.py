"""Training-data operators: dedup, secret scans, quality, media, tokens, packing and mixing.

Nothing else in the library imports this subpackage.
"""
