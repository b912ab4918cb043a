"""Training-data operators: ten document operators and the queries that apply them.

Nothing else in the library imports this package.
"""
