"""Sources of the search-ranking engine."""
