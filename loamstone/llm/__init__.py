"""Training-data operators: filters, near-duplicate joins, formatting, counting and mixing.

Nothing outside this subpackage imports it; `queries` holds the registered
queries and `oracles` the SQL they are compared with.
"""
