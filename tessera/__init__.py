"""tessera: a PySpark-native engine for candidate analytics and corpus preparation."""
