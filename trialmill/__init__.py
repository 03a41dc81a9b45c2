"""Spark-native cleaning and summarising of trial tables."""
