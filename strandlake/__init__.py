"""Spark-native analytics over genomic intervals, signal tracks and variant predictions."""
