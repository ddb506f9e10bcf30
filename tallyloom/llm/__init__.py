"""Operators that prepare training data: matching, counting, splitting, packing, leaks, personal data.

Nothing outside this folder imports it.
"""
