"""Spark-native analytics over tables of sequence alignments."""

__version__ = "0.2.0"
