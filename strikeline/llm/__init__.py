"""Training-data operators: packing, archives, quality, near-duplicates, token counts, scans, decontamination, sharding.

Nothing else in the library imports this subpackage.
"""
