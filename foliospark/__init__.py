"""A Spark-native engine for catalogues of short multilingual texts."""
