"""Spark-native analytics over semi-structured tables such as property listings and catalogues."""
