"""Training-data operators: URL filters, near-duplicates, fingerprints, classifiers, packing and tokenization.

Nothing outside this subpackage imports it.
"""
