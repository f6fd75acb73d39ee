"""cindertally: evaluation analytics for grouped, correlated observations, on Spark."""
