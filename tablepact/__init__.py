"""Contract-driven tables on Spark."""
