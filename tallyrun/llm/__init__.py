"""Operators for preparing training text: filtering, deduplication, packing, archives.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query per operator.
"""
