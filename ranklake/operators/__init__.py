"""Operators of the search-ranking engine."""
