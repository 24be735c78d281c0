"""Operators for preparing language-model training data.

Nothing else in the library imports this package; ``queries`` holds what the
entry module registers.
"""
