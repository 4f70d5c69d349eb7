"""A PySpark-native engine for similarity clustering of character sequences."""
