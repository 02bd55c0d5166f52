"""Sensor profiling, data quality and metadata-table jobs for Spark."""
