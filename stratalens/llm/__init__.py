"""Operators that prepare corpora for language-model training.

Nothing outside this subpackage imports it.
"""
