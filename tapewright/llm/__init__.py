"""Training-data operators: thirteen corpus operations and the queries that apply them.

Nothing else in the package imports this subpackage; it may be deleted whole.
"""
