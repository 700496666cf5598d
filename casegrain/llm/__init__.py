"""Operators for training data built from case documents.  Nothing else in the library imports this."""
