"""Functions of the search-ranking engine."""
