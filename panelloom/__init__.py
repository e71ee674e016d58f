"""PySpark-native equity-panel feature engine."""
