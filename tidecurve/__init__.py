"""tidecurve: a Spark-first engine for per-second signal curves and the records around them."""

__version__ = "0.1.0"
