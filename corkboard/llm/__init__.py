"""Training-data operators: mixing, quality, token files, language, counts, near and exact duplicates, fingerprints, WARC, BPE.

Nothing else in the library imports this subpackage.
"""
