"""lodestone: a Spark-native engine for retrieval over time-stamped evidence, its evaluation, and corpus preparation."""
