"""Training-data pipeline operators.

Self-contained: nothing else in the library imports this subpackage, and it imports nothing from
the rest of the library.  Each module holds one operator with a general interface; ``registry``
holds the thin ``opN_<name>`` queries and their SQL.
"""
