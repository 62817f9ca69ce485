"""Operators for preparing large text corpora: scoring, search, de-duplication and tokenising.

Nothing outside this subpackage imports it; it can be removed without touching the rest of the library.
"""
