"""Operators that prepare text corpora. Nothing outside this package imports it."""
