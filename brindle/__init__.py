"""Analytics operators, graph jobs, learning jobs and streaming jobs on PySpark."""
