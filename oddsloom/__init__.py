"""oddsloom: match analytics and training-data preparation as Spark DataFrame jobs."""

__version__ = "0.1.0"
