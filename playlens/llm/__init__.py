"""Operators of a training-data pipeline: one module per operator.

Nothing else in the library imports this subpackage; its queries and SQL live
in ``queries.py`` and ``oracle.py``.
"""
