"""Trajectory analytics as PySpark DataFrame plans."""
