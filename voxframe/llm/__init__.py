"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries`` registers the
``pN_...`` queries and ``sql`` their DuckDB counterparts.
"""
