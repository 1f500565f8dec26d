"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers the ``opN_<name>`` queries and their SQL.
"""
