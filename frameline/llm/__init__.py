"""Training-data operators: scoring, extraction, formatting, counting, joins, archives and search.

Nothing else in the library imports this subpackage.
"""
