"""gradus: a PySpark-native engine for rating, search, schedule and corpus analytics."""
