"""PySpark-native analytics over job postings; see README.md."""
