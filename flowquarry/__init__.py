"""Spark-native network-flow analytics: packets to flows, statistics, anomalies, verdicts."""
