"""strandlog: a PySpark-native ledger of training-data provenance and removal sets."""

__version__ = "0.1.0"
