"""Operators for preparing training text: classifiers, deduplication, search, filters and mixing."""
