"""Operators for preparing training text: each module holds one operator, ``registry`` its query and SQL.

Nothing else in the library imports this subpackage.
"""
