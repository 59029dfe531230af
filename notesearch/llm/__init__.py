"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general DataFrame interface; ``queries`` binds them to the synthetic tables.
"""
