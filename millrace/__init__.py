"""millrace: a Spark-native engine for building, scoring and analysing language-model training data."""
