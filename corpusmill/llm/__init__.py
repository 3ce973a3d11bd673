"""Training-data operators: deduplication, quality, language, tokens, fingerprints, URL rules, packing.

Nothing else in the library imports this subpackage.
"""
