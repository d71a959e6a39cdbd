"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator keeps a general
interface (DataFrame in, DataFrame out, column names as parameters); the registered
queries derive their digest columns from it, see ``registry``.
"""
