"""Lodestrand: a Spark-native engine that builds, audits and packs source-code corpora."""

__version__ = "0.1.0"
