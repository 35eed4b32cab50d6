"""Time-series anomaly detection on Spark."""
