"""Spark-native analytics of uncertainty and missing knowledge in discourse."""
