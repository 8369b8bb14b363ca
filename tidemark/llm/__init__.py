"""Operators for preparing training data, written for very large tables.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
