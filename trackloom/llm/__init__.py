"""Operators for preparing training corpora of language models.

Nothing outside this subpackage imports it.
"""
