"""Distributed first-order minimization on Spark tables.

The data *and* the parameter vector are DataFrames.  Heavy work is declared
as joins, aggregations and projections; the driver holds scalars only.
"""
