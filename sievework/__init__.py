"""Spark-native building blocks for preparing, auditing and scoring tuning corpora."""
