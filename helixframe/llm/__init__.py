"""Training-data operators: dedup, fingerprints, scoring, sharding, packing, tokenising, formatting and search.

Nothing else in the package imports this one.
"""
