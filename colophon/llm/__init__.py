"""Operators that prepare text and vectors for training corpora.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
