"""Spark-first analytics over recordings, frame streams and their labels."""
