"""Panel analytics on Spark: build, transform, forecast and score entity x month tables."""

__version__ = "0.1.0"
