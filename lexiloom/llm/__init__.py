"""Operators that prepare text collections for training.

Nothing outside this subpackage imports it.
"""
