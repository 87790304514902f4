"""A PySpark-native engine for slide annotations, measurements and specimen catalogues."""
