"""lexigrid: a Spark-native analytics library for linguistic, place-name and usage data."""
