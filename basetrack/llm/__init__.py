"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; its module docstring states the method, the partitioning
and what happens with nulls, empty texts, ties and repeated rows.
"""
