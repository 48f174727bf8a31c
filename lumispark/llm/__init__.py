"""Training-data operators: mixing, near duplicates, packing, search, fingerprints, secrets, toxicity, scoring, chat.

Nothing else in the library imports this subpackage.
"""
