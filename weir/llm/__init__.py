"""Operators for preparing training data: dedup, tokens, scores, scans, packing.

Nothing outside this folder imports it; it can be deleted as a whole.
"""
