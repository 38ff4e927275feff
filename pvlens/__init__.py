"""pvlens: Spark-native analytics for photovoltaic telemetry and inspection tables."""

__version__ = "0.1.0"
