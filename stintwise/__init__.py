"""Stint wear analytics as Spark plans: lap, telemetry, weather and corner tables in,
lap feature rows, wear models, evaluations and stint-life estimates out."""
