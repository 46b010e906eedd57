"""Observation, fact and entity memory analytics on PySpark: every operator is DataFrame in, DataFrame out."""
