"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` binds the operators to the
driver's tables and derives the columns of each query's contract.
"""
