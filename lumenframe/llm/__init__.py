"""Operators for building language-model training data.

Nothing else in the package imports this one; ``__spark_entry__`` adds its
queries only where it can be imported.
"""
