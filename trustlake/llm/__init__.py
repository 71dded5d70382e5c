"""Training-data operators: near duplicates, archives, filters, scans, search, tokens, packing, media, toxicity.

Nothing else in the library imports this subpackage.
"""
