"""A PySpark engine for open-ended survey answers: reshaping, counting, filtering and checking, all as DataFrames."""
