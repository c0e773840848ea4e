"""Training-data operators: language ID, LM scoring, near-duplicates, PII, BPE and more.

Nothing else in the library imports this subpackage.
"""
