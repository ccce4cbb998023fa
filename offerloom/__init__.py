"""Spark-native analytics over product-offer catalogues."""
