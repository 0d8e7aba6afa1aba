"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each ``opN_*`` module holds one
operator with a general interface and the thin query that ``registry`` exposes.
"""
