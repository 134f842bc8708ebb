"""Training-data operators: ten large-scale text operators and their queries.

Nothing outside this subpackage imports it.
"""
