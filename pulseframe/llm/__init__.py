"""Corpus preparation operators for large text collections.

Nothing outside this subpackage imports it; ``queries`` registers one query
per operator.
"""
