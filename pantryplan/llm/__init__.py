"""Training-data operators: near-dedup, archives, tokens, filters and scans.

Nothing outside this subpackage imports it.
"""
