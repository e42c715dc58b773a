"""Operators on texts and source files for training data."""
