"""Spark-native analytics over source text, usage logs, telemetry and state history."""
