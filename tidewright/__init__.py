"""A Spark-native engine for language-convention analysis of source text."""
