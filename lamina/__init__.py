"""lamina: a Spark-native analytics engine for layered agent memory."""
