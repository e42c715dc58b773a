"""symloom: a Spark-native engine for code-property graphs and the data processing around them."""
