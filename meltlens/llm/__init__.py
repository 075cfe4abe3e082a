"""Training-data operators: one module per operator, one query per operator.

Nothing outside this package imports it; ``queries`` collects the registered
queries and their SQL twins for the entry module.
"""
