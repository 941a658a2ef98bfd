"""Operators for preparing training text: filters, joins, packing, scoring and archives.

Nothing else in the library imports this subpackage.
"""
