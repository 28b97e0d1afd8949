"""A PySpark-native analytics engine for genomic data."""
