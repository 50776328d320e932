"""A Spark-native engine for schema-flexible documents."""
