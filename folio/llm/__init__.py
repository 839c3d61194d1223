"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries.py`` holds the registered ``opN_<name>`` queries.
"""
