"""Spark-native text protection: detect, resolve, tokenize, restore and audit sensitive spans."""
