"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it. ``registry`` has the registered
queries and their check SQL.
"""
