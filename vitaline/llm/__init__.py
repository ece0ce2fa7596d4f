"""Operators for text corpora and language-model data; nothing outside this package imports it."""
