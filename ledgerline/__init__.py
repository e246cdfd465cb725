"""Spark-native analytics over period-keyed statement facts."""
