"""recollect: conversation memory and training-data operators on PySpark."""

__version__ = "0.2.0"
