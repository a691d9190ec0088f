"""A Spark-native engine for event logs, event-sourced state and Petri-net models."""
