"""Sensor-reading risk analytics as Spark DataFrame transformations."""
