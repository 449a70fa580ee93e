"""Operators for preparing training data.

Nothing else in the package imports from here.  Each module holds one operator
with its own general interface; ``queries`` derives the registered queries.
"""
