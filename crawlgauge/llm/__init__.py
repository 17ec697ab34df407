"""Operators for preparing language-model training data at corpus scale.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
