"""A PySpark-native engine that validates, repairs and reports on parcel and line datasets."""
