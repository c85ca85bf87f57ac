"""storyloom: a Spark-native engine for ordered observations, entities and timelines."""
