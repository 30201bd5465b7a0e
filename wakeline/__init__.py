"""Analytics over recorded traffic of coding agents, as Spark jobs."""
