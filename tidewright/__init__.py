"""Time-series, strategy and portfolio analytics as Spark DataFrame plans."""
