"""DuckDB SQL twins of the registered Spark queries (the correctness oracle).

``base.with_star(sql)`` prefixes a query with the binding, staging, dimension and fact CTEs, so every
oracle query runs on the driver's tables alone.
"""
