"""Operators that prepare training corpora, each on its own module.

Nothing else in the library imports this package.
"""
