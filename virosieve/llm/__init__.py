"""Operators for building text corpora at scale; nothing else in the library imports them."""
