"""Training-data operators: tokens, near-duplicates, toxicity, sharding, archives.

Nothing else in the library imports this subpackage.
"""
