"""Training-data operators: extraction, formatting, scoring, tokenising, filters and deduplication.

Nothing else in the library imports this subpackage.
"""
