"""Operators for preparing training text: scoring, near-duplicates, mixing, sharding and the like.

Nothing else in the library imports this subpackage.
"""
