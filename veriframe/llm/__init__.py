"""Corpus operators for preparing language-model training data."""
