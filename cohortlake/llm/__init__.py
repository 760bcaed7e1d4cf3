"""Training-data operators: deduplication, decontamination, classifiers, tokens.

Nothing outside this package imports it.
"""
