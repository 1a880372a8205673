"""Plans of the search-ranking engine."""
