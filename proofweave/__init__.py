"""Evidence retrieval and answer validation as Spark DataFrame operators."""

__version__ = "0.1.0"
