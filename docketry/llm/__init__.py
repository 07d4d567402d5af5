"""Operators of a training-data pipeline over document tables.

Nothing outside this subpackage imports it; the registry adds its queries
only when it can be imported.
"""
