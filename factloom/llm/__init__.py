"""Operators for training-data pipelines over a ``documents`` or ``pages`` table.

Nothing outside this subpackage imports it.
"""
