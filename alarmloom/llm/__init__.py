"""Operators on text corpora for language models; nothing else in the library imports this package."""
