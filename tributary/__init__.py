"""A Spark engine for financial-report data: operators, scalar functions, sources, streams."""
