"""Operators for preparing training data: each is a Spark job over `documents`-like tables.

Nothing else in the package imports this subpackage.  ``queries`` holds the registered
queries and ``oracle`` their SQL.
"""
