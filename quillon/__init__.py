"""quillon: a Spark-native engine that profiles, checks, compares and reproduces data."""
