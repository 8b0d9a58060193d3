"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it. Each module holds one operator as a function
from DataFrames to a DataFrame; ``queries`` registers the ``opN_*`` queries.
"""
