"""sondhan: a Spark-native engine for multilingual retrieval and corpus curation."""

__version__ = "0.1.0"
