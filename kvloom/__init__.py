"""kvloom: Spark-native analytics for LLM-serving cache and data-movement workloads."""
