"""Training-data operators: fingerprints, filters, classifiers, media, packing and mixing.

Nothing outside this subpackage imports it.
"""
