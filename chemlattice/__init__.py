"""chemlattice: a Spark-native engine for molecule collections and bit fingerprints."""

__version__ = "0.1.0"
