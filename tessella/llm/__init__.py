"""Operators that prepare text, vectors and media for model training.

Nothing else in the library imports this subpackage.
"""
