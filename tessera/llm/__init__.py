"""Operators a training-data pipeline needs, over documents, pages and conversations.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only when the package is present.
"""
