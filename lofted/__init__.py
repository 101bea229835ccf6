"""Trajectory and telemetry analytics expressed as Spark DataFrame plans."""
