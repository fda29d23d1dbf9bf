"""Junctura: signal-performance analytics as composable PySpark DataFrame operators."""
