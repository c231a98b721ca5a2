"""Leakage-safe forecasting tables and training-data operators as Spark jobs."""
